"""The state algebra of aggregates: columns that can be stored, merged with later ones, and finished.

Every aggregate is described by ``AggState``: ``partial`` aggregates rows to state columns, ``merge`` aggregates state
columns of the same name, ``final`` is the result over merged columns. A FILTER clause only changes ``partial``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Call:
    """One aggregate: its kind, argument columns, constants among them, and FILTER."""

    kind: str
    args: tuple[Column, ...]
    constants: tuple[object, ...] = ()  # values of literal arguments, None for the others
    distinct: bool = False
    where: Column | None = None
    arg_type: str = ""  # of the first argument

    def arg(self, i: int = 0) -> Column:
        """An argument that is null where the FILTER does not hold."""
        return self.args[i] if self.where is None else F.when(self.where, self.args[i])


#: About what a row of state takes where nothing else is said.
ROW_BYTES = 64


@dataclass(frozen=True)
class AggState:
    """How an aggregate is kept.

    Most have a fixed number of columns for each group. Those with a ``value`` are kept as rows instead, one for each
    group and different value that is not null, with the number of its rows; ``counted`` aggregates the values and
    their numbers to the column "v". ``row_bytes`` is about what a group's columns take, None if that has no bound.
    """

    partial: dict[str, Column]
    merge: dict[str, Callable[[Callable[[str], Column]], Column]]
    final: Callable[[Callable[[str], Column]], Column]
    value: Column | None = None
    counted: Callable[[Column, Column], Column] | None = None
    row_bytes: int | None = ROW_BYTES


def _simple(partial: Column, merge: Callable[[Column], Column], final: Callable[[Column], Column] = lambda c: c, row_bytes: int | None = ROW_BYTES) -> AggState:
    return AggState({"v": partial}, {"v": lambda s: merge(s("v"))}, lambda s: final(s("v")), row_bytes=row_bytes)


def _valued(value: Column, counted: Callable[[Column, Column], Column], final: Callable[[Column], Column] = lambda c: c) -> AggState:
    return AggState({}, {}, lambda s: final(s("v")), value, counted)


def _count(call: Call) -> AggState:
    if call.distinct:
        return _distinct(call, lambda v, n: F.count(v), lambda n: F.coalesce(n, F.lit(0)).cast("long"))
    everything = call.where if call.where is not None else F.lit(True)
    for a in call.args:
        everything = everything & F.coalesce(a.isNotNull(), F.lit(False))
    return _simple(F.count(F.when(everything, F.lit(1))), F.sum, lambda n: F.coalesce(n, F.lit(0)).cast("long"))


def _distinct(call: Call, counted: Callable[[Column, Column], Column], final: Callable[[Column], Column] = lambda c: c) -> AggState:
    """The different values, or rows of values without a null."""
    value = call.args[0]
    if len(call.args) > 1:
        value = F.struct(*call.args)
    keep = call.where if call.where is not None else F.lit(True)
    for a in call.args:
        keep = keep & a.isNotNull()
    return _valued(F.when(keep, value), counted, final)


def _sum(call: Call) -> AggState:
    if call.distinct:
        return _distinct(call, lambda v, n: F.sum(v))
    return _simple(F.sum(call.arg()), F.sum)


def _avg(call: Call) -> AggState:
    if call.distinct:
        return _distinct(call, lambda v, n: F.avg(v))
    x = call.arg()
    return AggState({"s": F.sum(x), "n": F.count(x)}, {"s": lambda s: F.sum(s("s")), "n": lambda s: F.sum(s("n"))}, lambda s: F.when(s("n") > 0, s("s") / s("n")))


def _struct(always: Column, **fields: Column) -> Column:
    """A struct whose fields may be null, by a condition that always holds: in rows of values it is null as a whole, which Arrow only takes with such fields."""
    return F.struct(*(F.when(always, c).alias(name) for name, c in fields.items()))


def _folded(first: Column, add: Callable[[Column, Column], Column], final: Callable[[Column], Column]) -> AggState:
    """A struct of numbers with a count ``n``, merged two by two. A group has few rows of state when they are merged: what was kept and what is new."""
    pick = lambda a, b: F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(add(a, b))
    merge = lambda rows: F.reduce(F.slice(rows, 2, F.size(rows)), rows[0], pick)
    return _simple(first, lambda c: F.when(F.size(F.collect_list(c)) > 0, merge(F.collect_list(c))), final)


def _moments(final: Callable[[Column], Column], most: int = 2) -> Callable[[Call], AggState]:
    """Count, mean and sums of powers of deviations from the mean; those of two groups are moved to their common mean before they are added."""

    def add(a: Column, b: Column) -> Column:
        n, na, nb = a["n"] + b["n"], a["n"], b["n"]
        d = b["mean"] - a["mean"]
        out = [n.alias("n"), (a["mean"] + d * nb / n).alias("mean"), (a["m2"] + b["m2"] + d * d * na * nb / n).alias("m2")]
        if most > 2:
            m3 = a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n) + 3 * d * (na * b["m2"] - nb * a["m2"]) / n
            m4 = a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
            m4 = m4 + 6 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4 * d * (na * b["m3"] - nb * a["m3"]) / n
            out += [m3.alias("m3"), m4.alias("m4")]
        return F.struct(*out)

    def build(call: Call) -> AggState:
        x, zero = call.arg().cast("double"), F.lit(0.0)
        n, m2 = F.count(x).cast("double"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        first = {"n": n, "mean": F.coalesce(F.avg(x), zero), "m2": m2}
        if most > 2:
            first["m3"] = F.coalesce(F.when(m2 != 0, F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)), zero)
            first["m4"] = F.coalesce(F.when(m2 != 0, (F.kurtosis(x) + 3) * m2 * m2 / n), zero)
        return _folded(_struct(n >= 0, **first), add, final)

    return build


def _pairs(final: Callable[[Column], Column], swap: bool = False) -> Callable[[Call], AggState]:
    """The same for two variables, over rows in which both are present. ``swap``: the arguments come as (y, x)."""

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy, part = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * b["n"] / n
        return F.struct(
            n.alias("n"), (a["mx"] + dx * b["n"] / n).alias("mx"), (a["my"] + dy * b["n"] / n).alias("my"),
            (a["xx"] + b["xx"] + dx * dx * part).alias("xx"), (a["yy"] + b["yy"] + dy * dy * part).alias("yy"), (a["xy"] + b["xy"] + dx * dy * part).alias("xy"),
        )

    def build(call: Call) -> AggState:
        a, b = (call.arg(i).cast("double") for i in (0, 1))
        x, y = (b, a) if swap else (a, b)
        both = x.isNotNull() & y.isNotNull()
        x, y, n, zero = F.when(both, x), F.when(both, y), F.count(F.when(both, F.lit(1))).cast("double"), F.lit(0.0)
        first = _struct(
            n >= 0, n=n, mx=F.coalesce(F.avg(x), zero), my=F.coalesce(F.avg(y), zero),
            xx=F.coalesce(F.var_pop(x) * n, zero), yy=F.coalesce(F.var_pop(y) * n, zero), xy=F.coalesce(F.covar_pop(x, y) * n, zero),
        )
        return _folded(first, add, final)

    return build


def _skewness(c: Column) -> Column:
    return F.when(c["m2"] > 0, F.sqrt(c["n"]) * c["m3"] / F.sqrt(c["m2"] * c["m2"] * c["m2"]))


def _kurtosis(c: Column) -> Column:
    return F.when(c["m2"] > 0, c["n"] * c["m4"] / (c["m2"] * c["m2"]) - 3)


def _by(pick: Callable[[Column], Column]) -> Callable[[Call], AggState]:
    """max_by and min_by: the pair with the extreme key; of equal keys the extreme value."""

    def build(call: Call) -> AggState:
        value, key = call.args
        keep = key.isNotNull() if call.where is None else key.isNotNull() & call.where
        return _simple(pick(F.when(keep, _struct(key.isNotNull(), k=key, v=value))), pick, lambda c: c["v"])

    return build


def _list(call: Call) -> AggState:
    """Values in the order in which they were kept: older state first; Spark promises none."""
    if call.distinct:
        return _distinct(call, lambda v, n: F.collect_set(v))
    return _simple(F.collect_list(call.arg()), lambda s: F.flatten(F.collect_list(s)), row_bytes=None)


def _median(call: Call) -> AggState | None:
    return None if call.distinct else _valued(call.arg(), lambda v, n: F.percentile(v, 0.5, n))


def _percentile(call: Call) -> AggState | None:
    """Exact percentiles, one or an array of them, of values with their numbers; none where the query gives numbers of its own."""
    if call.distinct or len(call.constants) > 2 and call.constants[2] != 1:
        return None
    return _valued(call.arg(), lambda v, n: F.percentile(v, call.args[1], n))


def _mode(call: Call) -> AggState | None:
    """The commonest value, the smallest of equally common ones."""
    if call.distinct or len(call.args) > 1:
        return None
    return _valued(call.arg(), lambda v, n: F.min(F.when(v.isNotNull(), F.struct((-n).alias("n"), v.alias("v")))), lambda c: c["v"])


def _listagg(call: Call) -> AggState | None:
    if len(call.args) > 2:  # in an order of its own
        return None
    joined = lambda v: F.when(F.size(v) > 0, F.array_join(v, str(call.constants[1]) if call.constants[1] is not None else ""))
    if call.distinct:
        return _distinct(Call("ListAgg", call.args[:1], distinct=True, where=call.where), lambda v, n: F.collect_set(v), joined)
    return _simple(F.collect_list(call.arg()), lambda s: F.flatten(F.collect_list(s)), joined, row_bytes=None)


def _approx_percentile(call: Call) -> AggState | None:
    """A KLL sketch whose rank error, 2.296 / k ** 0.9433 at 99 % confidence, is 1 / accuracy; none where no sketch is that large."""
    share, accuracy = call.constants[1:3] if len(call.constants) > 2 else (None, None)
    if share is None or accuracy is None or call.distinct:
        return None
    size = max(200, math.ceil((2.296 * int(accuracy)) ** (1 / 0.9433)))
    if size > 65_535:
        return None
    x = call.arg().cast("double")
    quantile = lambda v: F.when(v.isNotNull() & (F.kll_sketch_get_n_double(v) > 0), F.kll_sketch_get_quantile_double(v, F.lit(float(share))))
    return AggState({"v": F.kll_sketch_agg_double(x, F.lit(size))}, {"v": lambda s: F.kll_merge_agg_double(s("v"), F.lit(size))}, lambda s: quantile(s("v")), row_bytes=32 * size)


def _hll(call: Call) -> AggState | None:
    """An HLL sketch whose relative error, 1.04 / sqrt(2 ** size), is at most the one asked for; none where no sketch is that large."""
    asked = call.constants[1] if len(call.constants) > 1 and call.constants[1] else 0.05
    size = max(14, math.ceil(2 * math.log2(1.04 / float(asked))))
    if size > 21:
        return None
    x = call.arg()
    return AggState(
        {"v": F.hll_sketch_agg(x.cast("string"), F.lit(size))}, {"v": lambda s: F.hll_union_agg(s("v"))},
        lambda s: F.coalesce(F.hll_sketch_estimate(s("v")), F.lit(0)).cast("long"), row_bytes=1 << size,
    )


_AGGREGATES: dict[str, Callable[[Call], AggState | None]] = {
    "Count": _count,
    "CountIf": lambda c: _simple(F.count(F.when(c.arg(), F.lit(1))), F.sum, lambda n: F.coalesce(n, F.lit(0)).cast("long")),
    "Sum": _sum, "Average": _avg,
    "Min": lambda c: _simple(F.min(c.arg()), F.min), "Max": lambda c: _simple(F.max(c.arg()), F.max),
    "BoolAnd": lambda c: _simple(F.bool_and(c.arg()), F.bool_and), "BoolOr": lambda c: _simple(F.bool_or(c.arg()), F.bool_or),
    "BitAndAgg": lambda c: _simple(F.bit_and(c.arg()), F.bit_and), "BitOrAgg": lambda c: _simple(F.bit_or(c.arg()), F.bit_or),
    "BitXorAgg": lambda c: None if c.distinct else _simple(F.bit_xor(c.arg()), F.bit_xor),
    "VariancePop": _moments(lambda c: F.when(c["n"] > 0, c["m2"] / c["n"])), "VarianceSamp": _moments(lambda c: F.when(c["n"] > 1, c["m2"] / (c["n"] - 1))),
    "StddevPop": _moments(lambda c: F.when(c["n"] > 0, F.sqrt(c["m2"] / c["n"]))), "StddevSamp": _moments(lambda c: F.when(c["n"] > 1, F.sqrt(c["m2"] / (c["n"] - 1)))),
    "CovPopulation": _pairs(lambda c: F.when(c["n"] > 0, c["xy"] / c["n"])), "CovSample": _pairs(lambda c: F.when(c["n"] > 1, c["xy"] / (c["n"] - 1))),
    "Corr": _pairs(lambda c: F.when((c["xx"] > 0) & (c["yy"] > 0), c["xy"] / F.sqrt(c["xx"] * c["yy"]))),
    "RegrCount": _pairs(lambda c: F.coalesce(c["n"], F.lit(0.0)).cast("long"), swap=True),
    "RegrAvgX": _pairs(lambda c: F.when(c["n"] > 0, c["mx"]), swap=True), "RegrAvgY": _pairs(lambda c: F.when(c["n"] > 0, c["my"]), swap=True),
    "RegrSXX": _pairs(lambda c: F.when(c["n"] > 0, c["xx"]), swap=True), "RegrSYY": _pairs(lambda c: F.when(c["n"] > 0, c["yy"]), swap=True),
    "RegrSXY": _pairs(lambda c: F.when(c["n"] > 0, c["xy"]), swap=True),
    "RegrSlope": _pairs(lambda c: F.when(c["xx"] > 0, c["xy"] / c["xx"]), swap=True),
    "RegrIntercept": _pairs(lambda c: F.when(c["xx"] > 0, c["my"] - c["xy"] / c["xx"] * c["mx"]), swap=True),
    "RegrR2": _pairs(lambda c: F.when(c["xx"] > 0, F.when(c["yy"] > 0, c["xy"] * c["xy"] / (c["xx"] * c["yy"])).otherwise(F.lit(1.0))), swap=True),
    "Skewness": _moments(_skewness, 4), "Kurtosis": _moments(_kurtosis, 4),
    "MaxBy": _by(F.max), "MinBy": _by(F.min),
    "CollectList": _list, "CollectSet": lambda c: _distinct(c, lambda v, n: F.collect_set(v)),
    "AnyValue": lambda c: _simple(F.any_value(c.arg(), F.lit(True)), lambda v: F.any_value(v, F.lit(True))) if c.where is None else None,
    "Median": _median, "Percentile": _percentile, "Mode": _mode, "ListAgg": _listagg, "ApproximatePercentile": _approx_percentile, "HyperLogLogPlusPlus": _hll,
}

#: Functions for which DISTINCT changes nothing.
_IDEMPOTENT = {"Min", "Max", "BoolAnd", "BoolOr", "BitAndAgg", "BitOrAgg", "CollectSet", "AnyValue", "HyperLogLogPlusPlus"}
_DISTINCT = {"Count", "Sum", "Average", "CollectList", "ListAgg"}

#: Names of the explicit interface.
BY_NAME = {
    "count": "Count", "count_if": "CountIf", "sum": "Sum", "avg": "Average", "min": "Min", "max": "Max", "bool_and": "BoolAnd", "bool_or": "BoolOr", "var_pop": "VariancePop", "var_samp": "VarianceSamp",
    "stddev_pop": "StddevPop", "stddev_samp": "StddevSamp", "covar_pop": "CovPopulation", "covar_samp": "CovSample", "corr": "Corr", "skewness": "Skewness", "kurtosis": "Kurtosis", "max_by": "MaxBy", "min_by": "MinBy",
    "collect_list": "CollectList", "collect_set": "CollectSet", "median": "Median", "approx_count_distinct": "HyperLogLogPlusPlus", "mode": "Mode", "percentile": "Percentile", "any_value": "AnyValue", "bit_and": "BitAndAgg",
    "bit_or": "BitOrAgg", "bit_xor": "BitXorAgg", "regr_count": "RegrCount", "regr_avgx": "RegrAvgX", "regr_avgy": "RegrAvgY", "regr_sxx": "RegrSXX", "regr_syy": "RegrSYY", "regr_sxy": "RegrSXY", "regr_slope": "RegrSlope",
    "regr_intercept": "RegrIntercept", "regr_r2": "RegrR2", "listagg": "ListAgg",
}


def decompose(call: Call) -> AggState | None:
    """The state of an aggregate, or None if it has none that merges to the same result."""
    build = _AGGREGATES.get(call.kind)
    if build is None or call.distinct and call.kind not in _DISTINCT | _IDEMPOTENT:
        return None
    return build(call)
