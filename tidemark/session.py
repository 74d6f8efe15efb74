"""The session that answers aggregate queries from stored state where it can, and leaves all others to Spark."""

from __future__ import annotations

import hashlib
import json
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import QueryCacheConfig
from .functions.state import BY_NAME, Call, decompose
from .log import AbstractLog, NoOpLog
from .operators.maintain import STATE_VERSION, Aggregation, CacheStats, is_temporal, run
from .plans import catalyst
from .plans.planner import Candidate, Planner, Table


class CachedSession:
    """``sql`` and ``run`` give lazy DataFrames with the rows that plain Spark would give.

    State is computed and stored when the query is planned; ``stats`` tells what the last query did, one entry for
    each aggregate that was kept.
    """

    def __init__(self, spark: SparkSession, config: QueryCacheConfig, log: AbstractLog | None = None):
        self.spark, self.config, self.log = spark, config, log or NoOpLog()
        self.stats: list[CacheStats] = []
        self._tables: dict[str, Table] = {}
        self._lock = threading.Lock()

    def register_table(self, name: str, df: DataFrame, source_id: str | None = None) -> None:
        """Makes ``df`` known as ``name``. Registering it again with more rows is how a table grows.

        The caller promises that the contents under one (name, schema, source_id) only grow, in time order; what
        ``df`` is made of does not enter the fingerprint.
        """
        df.createOrReplaceTempView(name)
        self._tables[name.lower()] = Table(name.lower(), df.schema.json(), source_id)

    def sql(self, text: str, **args) -> DataFrame:
        return self.run(self.spark.sql(text, **args))

    def run(self, df: DataFrame) -> DataFrame:
        """The same rows as ``df``, with its cacheable aggregates answered from state."""
        with self._lock:
            self.stats = []
            planner = Planner(self.spark, self.config, self._tables)
            plan = catalyst.analyzed(df)
            done = []
            for found in planner.candidates(plan):
                self._note(found)
                if found.aggregation is None:
                    continue
                try:
                    result, stats = run(self.spark, found.aggregation, self.config)
                    new = planner.replacement(found, result)
                except AnalysisException as e:  # a state that this aggregate's types do not allow
                    self.log.warn(found.fingerprint, f"no state of these types: {str(e).splitlines()[0]}")
                    continue
                self.log.info(found.fingerprint, "answered from state and newer rows" if stats.hit else "no state yet, answered from all rows")
                self.stats.append(stats)
                done.append((found, new))
            return catalyst.frame(self.spark, planner.spliced(plan, done)) if done else df

    def _note(self, found: Candidate) -> None:
        for reason in found.reasons:
            self.log.info(found.fingerprint, reason)
        if found.aggregation is not None:
            self.log.info(found.fingerprint, "its state can be kept")

    def explain(self, query: str | DataFrame, verbose: bool = False) -> str:
        """What would be done, without doing it: each aggregate's key, its cache state and bound, or why it is not kept."""
        df = self.spark.sql(query) if isinstance(query, str) else query
        out = []
        for found in Planner(self.spark, self.config, self._tables).candidates(catalyst.analyzed(df)):
            head = found.node.simpleString(200 if not verbose else 100_000)
            if found.aggregation is None:
                out.append(f"Aggregate: {head}\n  not cached: {'; '.join(found.reasons)}")
                continue
            entry = self.config.cache.entry(found.fingerprint)
            at = f"hit, rows with {found.temporal} >= {entry.timestamp()} are new" if entry.occupied() else "miss"
            out.append(f"QueryCacheAggregate: {head}\n  key: {found.fingerprint}\n  temporal column: {found.temporal}{' (bucketed)' if found.bucketed else ''}\n  {at}")
        if verbose:
            out.append(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(out) or "no aggregate"

    def explain_analyze(self, query: str | DataFrame) -> str:
        """Runs the query, which also updates the cache, and reports what each aggregate did."""
        df = self.sql(query) if isinstance(query, str) else self.run(query)
        rows = df.count()
        lines = [f"CacheUpdateAggregate: key={s.fingerprint[:12]} hit={s.hit} scanned={s.scanned} cached_rows={s.cached_rows} state_rows={s.fresh_rows} stored_rows={s.stored_rows}" for s in self.stats]
        return "\n".join([*lines, f"output rows: {rows}"])


def with_query_cache(spark: SparkSession, config: QueryCacheConfig, log: AbstractLog | None = None) -> CachedSession:
    return CachedSession(spark, config, log)


def explicit(df: DataFrame, temporal: str, keys: dict[str, Column | str] | None = None, aggs: dict[str, tuple] | None = None, name: str = "") -> Aggregation:
    """The aggregation that ``cached_agg`` describes."""
    keys = {k: F.col(v) if isinstance(v, str) else v for k, v in (keys or {}).items()}
    kind = df.schema[temporal].dataType
    if not is_temporal(kind):
        raise ValueError(f"{temporal} is no date or timestamp")
    column = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    constant = lambda x: None if isinstance(x, str | Column) else x
    calls = {a: Call(BY_NAME[f], tuple(column(x) for x in args), tuple(constant(x) for x in args)) for a, (f, *args) in (aggs or {}).items()}
    states = [decompose(c) for c in calls.values()]
    if None in states:
        raise ValueError("an aggregate has no state that merges")
    plain = df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*(getattr(F, f)(*args).alias(a) for a, (f, *args) in aggs.items()))
    types = [plain.schema[a].dataType.simpleString() for a in calls]
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    spec = {"name": name, "schema": df.dtypes, "temporal": temporal, "zone": zone, "keys": {k: str(c) for k, c in keys.items()}, "aggs": {a: [f, *map(str, args)] for a, (f, *args) in aggs.items()}, "version": STATE_VERSION}
    return Aggregation(df, F.col(temporal), kind, list(keys.values()), states, types, hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest())


def cached_agg(df: DataFrame, config: QueryCacheConfig, temporal: str, keys: dict[str, Column | str] | None = None, aggs: dict[str, tuple] | None = None, name: str = "", **how) -> tuple[DataFrame, CacheStats]:
    """The explicit form: no plan is read. aggs: {"avg_value": ("avg", "value"), "n": ("count", F.lit(1))}.

    ``name`` stands for the data in the fingerprint; the caller promises that it only grows, in the order of the
    column ``temporal``. ``how`` goes to ``maintain.run``.
    """
    result, stats = run(df.sparkSession, explicit(df, temporal, keys, aggs, name), config, **how)
    names = [*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys or {})), *(F.col(f"a{i}").alias(a) for i, a in enumerate(aggs or {}))]
    return result.select(*names), stats
