"""Incremental maintenance: stored state, plus the state of rows since, gives the result and the next stored state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import QueryCacheConfig
from ..functions.state import ROW_BYTES, AggState
from ..sources.cache import CacheEntry, OccupiedEntry, State
from ..sources.folders import own_folder

#: Goes up when the meaning of stored state changes.
STATE_VERSION = "3"

TAIL = "is_tail"
#: Which aggregate's values a row of state holds: 0 for the columns of the group, i + 1 for a value of aggregate i.
PART = "part"
#: Rows of state that are aggregated together: all, or those of groups and those of values apart.
ALL, GROUPS, VALUES = range(3)
_DAY = 86_400_000_000


@dataclass
class CacheStats:
    """What one run did: rows of state read, in the result and stored, and the bound of the scan (microseconds of the temporal column).

    ``scanned`` is false where the files that the state was made of had not changed, so nothing was read but state.
    """

    fingerprint: str
    hit: bool
    cached_rows: int = 0
    fresh_rows: int = 0
    stored_rows: int = 0
    lower_bound: int | None = None
    now: int | None = None
    stored: bool = False
    scanned: bool = True


@dataclass
class Floor:
    """A lower bound that moves with the clock, over an aggregation by time buckets (key number ``key``).

    Times are text in the session's zone: ``at`` the bound, ``bucket`` the bucket that it cuts, which ends at ``end``.
    """

    key: int
    strict: bool
    at: str
    bucket: str
    end: str


@dataclass
class Aggregation:
    """A cacheable aggregation over ``base``, whose rows are ordered in time by ``temporal``."""

    base: DataFrame
    temporal: Column
    temporal_type: T.DataType
    keys: list[Column]
    states: list[AggState]
    types: list[str]
    fingerprint: str
    snapshot: str | None = None
    floor: Floor | None = None

    @property
    def valued(self) -> list[int]:
        """The aggregates that are kept as rows of values."""
        return [i for i, s in enumerate(self.states) if s.value is not None]

    @property
    def group(self) -> list[str]:
        """The columns that tell rows of state apart, besides TAIL."""
        return [*(f"k{i}" for i in range(len(self.keys))), *([PART] if self.valued else []), *(f"v{i}" for i in self.valued)]

    @property
    def kinds(self) -> tuple[int, ...]:
        """What is aggregated by itself. A sketch has its whole buffer (340 KB for a quantile at Spark's accuracy) and a list its own from the
        start, in every row of an aggregation, so rows of values beside them are aggregated without."""
        large = any(s.value is None and s.row_bytes != ROW_BYTES for s in self.states)
        return (GROUPS, VALUES) if self.valued and large else (ALL,)

    def driver_rows(self, config: QueryCacheConfig) -> int:
        """How many rows of state may be kept in the driver."""
        sizes = [s.row_bytes for s in self.states]
        return 0 if None in sizes else min(config.driver_rows, config.driver_bytes // max(1, sum(sizes)))


def bound_literal(micros: int, kind: T.DataType) -> Column:
    """A time as a literal of the temporal column's type."""
    when = datetime(1970, 1, 1) + timedelta(microseconds=micros)
    if isinstance(kind, T.DateType):
        return F.lit(when.date())
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(when.replace(tzinfo=UTC))


def column_time(spark: SparkSession, micros: int, kind: T.DataType) -> int:
    """A time as the temporal column shows it, at its precision: without a zone it is the session zone's clock."""
    if isinstance(kind, T.TimestampType):
        return micros
    when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)
    zone = spark.conf.get("spark.sql.session.timeZone")
    local = (when.astimezone(ZoneInfo(zone)).replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return local // _DAY * _DAY if isinstance(kind, T.DateType) else local


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def fresh_rows(agg: Aggregation, bound: int | None) -> DataFrame:
    """The rows that stored state does not cover. Rows without a time are never stored, so they always belong here."""
    if bound is None:
        return agg.base
    return agg.base.where((agg.temporal >= bound_literal(bound, agg.temporal_type)) | agg.temporal.isNull())


def by_kind(agg: Aggregation, made: Callable[[int], DataFrame]) -> DataFrame:
    """The state whose rows of each kind ``made`` gives."""
    if agg.kinds == (ALL,):
        return made(ALL)
    groups, values = (made(kind) for kind in agg.kinds)
    order = [*values.columns, *(c for c in groups.columns if c not in values.columns)]
    return groups.withColumn(PART, F.lit(0)).unionByName(values, allowMissingColumns=True).select(*order)


def of_kind(agg: Aggregation, state: DataFrame, kind: int) -> DataFrame:
    """The rows of one kind, with the columns that they fill."""
    if kind == ALL:
        return state
    if kind == GROUPS:
        return state.where(F.col(PART) == 0).drop(PART, *(f"v{i}" for i in agg.valued))
    return state.where(F.col(PART) > 0).drop(*(c for c in state.columns if c.startswith("s")))


def partial_state(agg: Aggregation, rows: DataFrame, now: int, kind: int | None = None) -> DataFrame:
    """State of ``rows``, in one pass over them for each kind: a row for each group and, where aggregates keep values, for each of those."""
    if kind is None:
        return by_kind(agg, lambda kind: partial_state(agg, rows, now, kind))
    tail = F.coalesce(agg.temporal >= bound_literal(now, agg.temporal_type), F.lit(True)).alias(TAIL)
    keys = [k.alias(f"k{i}") for i, k in enumerate(agg.keys)]
    columns = [c.alias(f"s{i}_{name}") for i, s in enumerate(agg.states) for name, c in s.partial.items()]
    count = F.count(F.lit(1)).alias("rows")
    if not agg.valued or kind == GROUPS:
        return rows.groupBy(*keys, tail).agg(count, *columns)
    first, columns = ([], []) if kind == VALUES else ([F.lit(0)], columns)
    parts = F.array_compact(F.array(*first, *(F.when(agg.states[i].value.isNotNull(), F.lit(i + 1)) for i in agg.valued)))
    values = [F.when(F.col(PART) == i + 1, agg.states[i].value).alias(f"v{i}") for i in agg.valued]
    state = rows.withColumn(PART, F.explode(parts)).groupBy(*keys, tail, PART, *values).agg(count, *columns)
    return state.select(*(F.when(F.col(PART) == 0, F.col(c)).alias(c) if c.startswith("s") else c for c in state.columns))


def merged_state(agg: Aggregation, state: DataFrame, by: list[str], kind: int | None = None) -> DataFrame:
    """One row for each different ``by``: the state stays as large as the number of groups and values."""
    if kind is None:
        return by_kind(agg, lambda kind: merged_state(agg, of_kind(agg, state, kind), by, kind))
    by = [c for c in by if c in state.columns]
    columns = [F.sum("rows").alias("rows")]
    for i, s in enumerate(agg.states if kind != VALUES else []):
        field = lambda name, i=i: F.col(f"s{i}_{name}")
        columns += [s.merge[name](field).cast(state.schema[f"s{i}_{name}"].dataType).alias(f"s{i}_{name}") for name in s.partial]
    return state.groupBy(*by).agg(*columns)


def grouped_values(agg: Aggregation, state: DataFrame) -> DataFrame:
    """Merged state with its rows of values aggregated: one row for each group, with a column s<i>_v for each aggregate that keeps values."""
    main = [F.any_value(F.when(F.col(PART) == 0, F.col(c)), F.lit(True)).alias(c) for c in state.columns if c.startswith("s")]
    values = [agg.states[i].counted(F.when(F.col(PART) == i + 1, F.col(f"v{i}")), F.col("rows")).alias(f"s{i}_v") for i in agg.valued]
    return state.groupBy(*(f"k{i}" for i in range(len(agg.keys)))).agg(*main, *values)


def finished(agg: Aggregation, state: DataFrame, merged: bool = False) -> DataFrame:
    """Columns k0, k1, ... and a0, a1, ...: the aggregation's result. Without keys there is one row, even of no rows.

    ``merged`` says that no group has two rows of state, so that nothing needs to be merged any more.
    """
    keys = [f"k{i}" for i in range(len(agg.keys))]
    merged = state if merged else merged_state(agg, state, agg.group)
    if agg.valued:
        merged = grouped_values(agg, merged)
    out = [F.col(k) for k in keys]
    for i, s in enumerate(agg.states):
        field = lambda name, i=i: F.col(f"s{i}_{name}")
        out.append(s.final(field).alias(f"a{i}"))
    plain = merged.select(*out)
    # A cast would change what is known about nulls inside arrays, so there is one only where the type differs.
    same = lambda i: plain.schema[f"a{i}"].dataType.simpleString().lower() == agg.types[i].lower()
    return plain.select(*keys, *(F.col(f"a{i}") if same(i) else F.col(f"a{i}").cast(agg.types[i]).alias(f"a{i}") for i in range(len(agg.types))))


def above_floor(agg: Aggregation, state: DataFrame, now: int) -> DataFrame:
    """State of the rows above a moving bound: whole buckets as they are kept, the bucket that it cuts from its rows."""
    floor, key = agg.floor, agg.keys[agg.floor.key]
    kept = F.col(f"k{floor.key}")
    bucket = F.lit(floor.bucket).cast(state.schema[f"k{floor.key}"].dataType)
    at, end = (F.lit(x).cast(agg.temporal_type) for x in (floor.at, floor.end))
    rows = agg.base.where((agg.temporal > at if floor.strict else agg.temporal >= at) & (agg.temporal < end) & (key == bucket))
    return state.where(kept > bucket).unionByName(partial_state(agg, rows, now).select(*state.columns))


def usable(entry: CacheEntry, schema: T.StructType) -> bool:
    """Whether stored state has the meaning and the columns that this aggregation would store."""
    if not isinstance(entry, OccupiedEntry):
        return False
    state = entry.get()
    same = [(f.name, f.dataType) for f in state.schema] == [(f.name, f.dataType) for f in schema]
    return state.version == STATE_VERSION and same


def _stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema if f.name != TAIL])


def run(spark: SparkSession, agg: Aggregation, config: QueryCacheConfig, mode: str = "query", since: int | None = None, note: Callable[[CacheStats], dict] | None = None) -> tuple[DataFrame, CacheStats]:
    """The aggregation's result, lazily, after its state has been computed and stored.

    The new rows are read by one job, whose result is kept in the driver or, beyond ``driver_rows`` rows or
    ``driver_bytes`` bytes, in files. Rows at or after ``now`` and rows without a time enter the result but not the
    stored state. Where the files that state was made of are as they were, nothing is read.

    ``mode`` "feed" says that the rows from ``since`` on are new to the stored state, whatever their times; "read"
    leaves the stored state as it is. What ``note`` gives is stored along with the state.
    """
    now = column_time(spark, config.clock(), agg.temporal_type)
    entry = config.cache.entry(agg.fingerprint)
    bound = entry.timestamp() if isinstance(entry, OccupiedEntry) else None
    # An older clock than the stored one adds nothing to the store; all later rows are then computed anew.
    fresh = fresh_rows(agg, since if mode == "feed" else bound)
    until = now if bound is None else max(now, bound)
    state = partial_state(agg, fresh, until)
    names = [*(f.name for f in state.schema if f.name != TAIL), TAIL]
    schema = _stored_schema(state.schema)
    hit = usable(entry, schema)
    if bound is not None and not hit:
        bound, until, state = None, now, partial_state(agg, agg.base, now)
    stats = CacheStats(agg.fingerprint, hit, lower_bound=bound, now=now)
    whole = T.StructType([*schema.fields, T.StructField(TAIL, T.BooleanType())])
    held = entry.get() if hit else None

    def result(frame: DataFrame, merged: bool) -> DataFrame:
        return finished(agg, frame, merged) if agg.floor is None else finished(agg, above_floor(agg, frame, until))

    if hit:
        stats.cached_rows = held.rows
        if mode != "feed" and agg.snapshot is not None and held.snapshot == agg.snapshot:
            stats.fresh_rows, stats.stored_rows, stats.scanned = held.rows + held.tail_rows, held.rows, False
            if held.table is None:
                frame = held.frame(spark).withColumn(TAIL, F.lit(False))
            else:
                frame = State(whole, table=_with_tail(held.table, held.tail)).frame(spark).coalesce(1)
            return result(frame, not held.tail_rows and (held.rows > 0 or bool(agg.keys))), stats
        known = held.frame(spark).withColumn(TAIL, F.lit(False))
        both = lambda kind: partial_state(agg, fresh, until, kind).unionByName(of_kind(agg, known, kind))
        state = by_kind(agg, lambda kind: merged_state(agg, both(kind), [*agg.group, TAIL], kind))
    state = state.select(*names)
    most = agg.driver_rows(config)
    got = path = None
    if most and not (hit and held.rows > most):
        # What turns out to be too large is not computed again to be written.
        kept = state.persist(StorageLevel.MEMORY_AND_DISK) if agg.group and (not hit or 2 * held.rows > most) else state
        got = (kept.limit(most + 1) if agg.group else kept).toArrow()
        if got.num_rows > most:
            got, path, counts = None, *_written(spark, kept)
        if kept.is_cached:
            kept.unpersist()
    else:
        path, counts = _written(spark, state)
    if got is not None:
        old = got.filter(pc.invert(got.column(TAIL))).drop_columns([TAIL])
        tail = got.filter(got.column(TAIL)).drop_columns([TAIL])
        stored = State(schema, table=old, version=STATE_VERSION, tail=tail, snapshot=agg.snapshot)
        frame = State(whole, table=got).frame(spark).coalesce(1)
        merged = old.num_rows in (0, got.num_rows) and (got.num_rows > 0 or bool(agg.keys))
        stats.fresh_rows, stats.stored_rows = got.num_rows, old.num_rows
    else:
        frame, merged = spark.read.schema(whole).parquet(path), False
        stored = State(schema, path=f"{path}/{TAIL}=false", version=STATE_VERSION, n=counts[1], snapshot=agg.snapshot if counts[0] == counts[1] else None)
        if not counts[1]:
            stored = State(schema, table=pa.Table.from_pylist([], schema=_arrow(spark, schema)), version=STATE_VERSION)
        stats.fresh_rows, stats.stored_rows = counts
    if mode == "feed" or mode == "query" and (not hit or now > bound):
        entry.put(until, stored if note is None else replace(stored, note=note(stats)))
        stats.stored = True
    return result(frame, merged), stats


def _with_tail(stored: pa.Table, tail: pa.Table | None) -> pa.Table:
    flagged = lambda t, flag: t.append_column(TAIL, pa.array([flag] * t.num_rows, pa.bool_()))
    whole = flagged(stored, False)
    return whole if tail is None or not tail.num_rows else pa.concat_tables([whole, flagged(tail, True).cast(whole.schema)])


def _written(spark: SparkSession, state: DataFrame) -> tuple[str, tuple[int, int]]:
    """The folder with ``state``, by tail, and its numbers of rows and of rows to store."""
    path, seen = _folder(spark), Observation()
    counted = state.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col(TAIL), F.lit(1))).alias("stored"))
    counted.write.mode("append").partitionBy(TAIL).parquet(path)
    return path, (seen.get["rows"], seen.get["stored"])


def _folder(spark: SparkSession) -> str:
    return own_folder(spark, "state")


def _arrow(spark: SparkSession, schema: T.StructType) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema
