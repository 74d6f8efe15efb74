"""The cache's parts, and incremental results against plain Spark."""

import io
import random
import re
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Level, MemoryLog, MemoryQueryCache, NoOpLog, ParquetQueryCache, QueryCacheConfig, State, StderrLog, cached_agg, with_query_cache
from tidemark.config import micros
from tidemark.plans.classify import Node, dependence

START = datetime(2024, 1, 1)
TEMPORAL = frozenset({"t.ts"})
TS, VALUE, LIT, NOW = Node("AttributeReference", column="t.ts"), Node("AttributeReference", column="t.value"), Node("Literal"), Node("Now")


def op(kind, *children, **more):
    return Node(kind, children, **more)


@pytest.mark.parametrize(
    ("node", "want"),
    [
        (LIT, "fixed"), (VALUE, "fixed"), (TS, "fixed"), (NOW, "clock"), (Node("CurrentDate"), "clock"), (Node("LocalTimestamp"), "clock"),
        (op("Like", VALUE, LIT), "fixed"), (op("IsNotNull", VALUE), "fixed"), (op("IsNull", op("Rand", deterministic=False)), "refused"),
        (op("Not", op("EqualTo", VALUE, LIT)), "fixed"), (op("Not", NOW), "clock"), (op("UnaryMinus", VALUE), "fixed"),
        (op("GreaterThan", TS, LIT), "fixed"), (op("GreaterThanOrEqual", TS, op("Subtract", NOW, LIT)), "floor"),
        (op("GreaterThan", op("Cast", TS), NOW), "floor"), (op("LessThan", NOW, TS), "floor"), (op("LessThanOrEqual", LIT, TS), "fixed"),
        (op("LessThan", TS, LIT), "fixed"), (op("LessThan", TS, NOW), "clock"), (op("GreaterThan", VALUE, NOW), "clock"),
        (op("And", op("GreaterThan", TS, LIT), op("EqualTo", VALUE, LIT)), "fixed"), (op("And", op("GreaterThan", TS, NOW), op("EqualTo", VALUE, LIT)), "floor"),
        (op("And", op("GreaterThan", TS, NOW), op("GreaterThan", TS, NOW)), "refused"), (op("And", op("GreaterThan", TS, NOW), op("LessThan", TS, NOW)), "clock"),
        (op("Or", op("EqualTo", VALUE, LIT), op("EqualTo", VALUE, LIT)), "fixed"), (op("Or", op("GreaterThan", TS, NOW), LIT), "refused"),
        (op("Upper", VALUE), "fixed"), (op("In", VALUE, LIT, LIT), "fixed"), (op("CaseWhen", VALUE, LIT, LIT), "fixed"),
        (op("GreaterThan", VALUE, Node("ScalarSubquery")), "refused"), (op("GreaterThan", TS, op("Rand", deterministic=False)), "refused"), (op("PythonUDF", VALUE), "refused"),
    ],
)
def test_classifier(node, want):
    facts = dependence(node, TEMPORAL)
    kinds = {"fixed": facts.fixed, "floor": facts.floor is not None, "clock": facts.clock and not facts.unknown, "refused": bool(facts.unknown) or len(facts.floors) > 1 and not facts.clock}
    assert [k for k, v in kinds.items() if v] == [want]
    assert bool(facts.reason) == (want != "fixed")


def test_config():
    config = QueryCacheConfig("T.ts", MemoryQueryCache())
    assert config.default_temporal_column == "t.ts" and config.allow_temporal_column("t.TS") and not config.allow_group_by_function("date_trunc")
    more = config.with_temporal_column("u.at").with_group_by_function("Date_Trunc").with_override_now(datetime(1970, 1, 1, 0, 0, 1))
    assert more.allow_temporal_column("u.at") and more.allow_group_by_function("date_trunc") and more.clock() == 1_000_000
    assert not config.allow_temporal_column("u.at") and abs(config.with_override_now(None).clock() - micros(datetime.now().astimezone())) < 10_000_000
    with pytest.raises(ValueError):
        QueryCacheConfig("ts", MemoryQueryCache())


def a_state(value):
    return State(T.StructType([T.StructField("k0", T.LongType())]), table=pa.table({"k0": [value]}), version="1")


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_cache_entries(spark, tmp_path, kind):
    cache = MemoryQueryCache() if kind == "memory" else ParquetQueryCache(spark, f"file://{tmp_path}/c")
    read = lambda e: [r.k0 for r in e.get().frame(spark).collect()]
    vacant = cache.entry("a")
    assert not vacant.occupied()
    vacant.put(5, a_state(1))
    entry = cache.entry("a")
    assert entry.occupied() and entry.timestamp() == 5 and read(entry) == [1]
    entry.put(7, a_state(2))
    assert entry.timestamp() == 5 and read(entry) == [1]  # as it was at the lookup
    assert cache.entry("a").timestamp() == 7 and read(cache.entry("a")) == [2]
    entry.put(6, a_state(4))  # another session that has waited with an older time
    assert cache.entry("a").timestamp() == 7 and read(cache.entry("a")) == [2]
    entry.put(7, State(a_state(1).schema, table=a_state(3).table, version="1", note={"batch": 4}))
    assert cache.entry("a").get().note == {"batch": 4} and cache.entry("a").get().rows == 1
    cache.entry("b").put(1, a_state(9))
    cache.remove("a")
    assert not cache.entry("a").occupied() and cache.entry("b").occupied()
    cache.clear()
    assert not cache.entry("b").occupied()


def test_memory_cache_limits_and_display():
    cache = MemoryQueryCache(max_entries=2)
    for i, name in enumerate("abc"):
        cache.entry(name).put(i, a_state(i))
    assert len(cache) == 2 and not cache.entry("a").occupied() and "### c" in repr(cache)
    assert cache.display().startswith("## MemoryQueryCache:") and "timestamp: 2 data:" in cache.display()


def test_logs(capsys):
    log = MemoryLog()
    log.info("f", "one")
    log.warn("f", "two")
    log.info("g", "three")
    assert [(e.query_fingerprint, e.messages) for e in log.history()] == [("f", [(Level.INFO, "one"), (Level.WARN, "two")]), ("g", [(Level.INFO, "three")])]
    assert NoOpLog().history() is None
    out = io.StringIO()
    colours = StderrLog(out)
    colours.info("f", "one")
    colours.warn("f", "two")
    assert out.getvalue().count("\x1b[32mf") == 1 and "\x1b[33m" in out.getvalue()

    class Broken(NoOpLog):
        def log(self, *args):
            raise OSError("no disk")

    Broken().info("f", "x")  # must not raise


def rows(spark, n=400, seed=1, late_nulls=True):
    random.seed(seed)
    data = [(START + timedelta(minutes=i * 7), random.choice(["a", "b", "c", None]), random.choice([None, random.randint(-50, 50)]), random.random() * 10) for i in range(n)]
    if late_nulls:
        data += [(None, "a", 5, 1.0), (None, None, None, 2.0)]
    return spark.createDataFrame(data, "ts timestamp_ntz, service string, value long, weight double")


AGGREGATES = [
    "count(*)", "count(value)", "sum(value)", "min(value)", "max(service)", "avg(value)", "stddev(value)", "var_pop(weight)", "corr(value, weight)", "covar_samp(value, weight)", "regr_slope(value, weight)", "regr_intercept(value, weight)",
    "regr_r2(value, weight)", "skewness(value)", "kurtosis(value)", "count(distinct value)", "sum(distinct value)", "avg(distinct value)", "bool_or(value > 10)", "count_if(value > 0)", "bit_xor(value)", "max_by(value, ts)", "min_by(service, weight)",
    "median(value)", "percentile(weight, 0.25)", "percentile(value, array(0.0, 0.9, 1.0))", "mode(value % 3, true)", "median(weight) filter (where value > 0)", "count(distinct service, value)", "sort_array(collect_list(distinct value))", "stddev_samp(value + 1e9)", "kurtosis(weight + 1e6)",
    "skewness(weight - 1e6)", "corr(value + 1e8, weight - 1e8)", "regr_sxy(value, weight + 1e7)", "regr_avgx(value, weight)", "regr_count(value, weight)", "sum(value) filter (where service = 'a')", "sum(cast(weight as decimal(10, 3)))", "avg(cast(weight as decimal(10, 3)))", "sum(distinct cast(value as decimal(8, 2)))", "sum(distinct cast(value as tinyint))", "max(cast(value as decimal(8, 2)))", "sort_array(collect_set(value))", "sort_array(collect_list(value))", "approx_count_distinct(service)", "mode(abs(value) % 1)", "length(listagg(service, ', '))", "length(listagg(distinct service))",
]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-7, abs=1e-7, nan_ok=True)
    return a == b


def check(session, sql, plain):
    got, want = session.sql(sql), plain.sql(sql)
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = sorted(got.collect(), key=str), sorted(want.collect(), key=str)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), (a, b)


@pytest.mark.parametrize("group", ["", "group by service", "group by date_trunc('day', ts)"])
def test_increments_equal_plain_spark(spark, group):
    """Several runs as the table grows, with rows beyond the clock, rows without a time, and an empty start."""
    key = group.removeprefix("group by ")
    select = ", ".join([*([f"{key} as k"] if key else []), *(f"{a} as a{i}" for i, a in enumerate(AGGREGATES))])
    data, cache = rows(spark), MemoryQueryCache()
    for minutes, ahead in ((0, 0), (700, 100), (1500, 0), (9999, 0)):
        now = START + timedelta(minutes=minutes)
        config = QueryCacheConfig("t.ts", cache).with_group_by_function("date_trunc").with_override_now(now)
        session = with_query_cache(spark, config)
        session.register_table("t", data.where((F.col("ts") < F.lit(now + timedelta(minutes=ahead)).cast("timestamp_ntz")) | F.col("ts").isNull()))
        check(session, f"select {select} from t {group}", spark)
        assert session.stats[0].hit == (minutes > 0)


def test_mode_and_quantile_sketch(spark):
    data, cache = rows(spark, late_nulls=False), MemoryQueryCache()
    for hour in (10, 30, 99):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data)
        common, middle = session.sql("select mode(value), approx_percentile(weight, 0.5) from t").first()
        assert len(session.stats) == 1
    counts = data.where("value is not null").groupBy("value").count().orderBy(F.desc("count"), "value").first()
    exact = data.select(F.percentile("weight", F.lit(0.5))).first()[0]
    assert common == counts.value and abs(middle - exact) < 0.3


def test_quantile_sketch_is_as_accurate_as_asked(spark):
    """Ranks among 400,000 distinct values, with Spark's own accuracy of 1/10000, over two runs; a greater one is not cached."""
    n, cache = 400_000, MemoryQueryCache()
    data = spark.range(n).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7200).cast("timestamp_ntz").alias("ts"), ((F.col("id") * 7919) % n).alias("x"))
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    for hour in (1, 3):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data)
        got = session.sql(f"select {', '.join(f'approx_percentile(x, {s})' for s in shares)} from t").first()
        assert len(session.stats) == 1 and max(abs(x / n - s) for x, s in zip(got, shares, strict=True)) <= 2e-4
    session.sql("select approx_percentile(x, 0.5, 1000000) from t").first()
    assert not session.stats


def test_sketches_and_lists_have_no_buffers_for_values(spark, monkeypatch):
    """Beside exact percentiles, a sketch or list is aggregated by group only, in runs without and with stored state; the rows of values have none."""
    from tidemark.operators import maintain

    written, write, cache = [], maintain._written, MemoryQueryCache()
    monkeypatch.setattr(maintain, "_written", lambda spark, state: written.append(state) or write(spark, state))
    data = spark.range(3000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7200).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("k"), (F.col("id") % 1000).cast("double").alias("x"))
    data = data.union(spark.sql("select timestamp_ntz'2024-01-01 00:10:00', 3L, cast(null as double)"))
    data.createOrReplaceTempView("sketched")
    text = "select k, percentile(x, 0.9) as p, approx_percentile(x, 0.9) as a, median(x) as m, approx_count_distinct(x) as d, size(collect_list(x)) as l, count(*) as n from {} group by k order by k"
    for hour in (0.5, 3):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache, driver_rows=0).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data)
        out = session.sql(text.format("t"))
        assert session.stats[0].hit == (hour == 3)
        got, want = out.collect(), spark.sql(text.format("sketched")).collect()
        assert [(r.k, r.p, r.m, r.l, r.n) for r in got] == [(r.k, r.p, r.m, r.l, r.n) for r in want]
        assert all(a.a == b.a or abs(a.a - b.a) <= 1 for a, b in zip(got, want, strict=True)) and all(abs(a.d - 1000 * (a.k < 3)) <= 30 for a in got)
        for frame in (written[-1], out):
            plan = frame._jdf.queryExecution().analyzed().toString().split("\n")
            grouped = [line.split("Aggregate [")[1].split("], [")[0] for line in plan if re.search(r"Aggregate .*(kll|hll)_", line)]
            assert grouped and not any(re.search(r"\b(part|v\d+)#|CASE WHEN", g) for g in grouped)
        state = written[-1].where("part > 0")
        assert state.count() and not state.where(" or ".join(f"{c} is not null" for c in state.columns if c.startswith("s"))).count()


def test_state_stays_as_large_as_its_groups(spark):
    data, cache = rows(spark, late_nulls=False), MemoryQueryCache()
    for hour in range(1, 6):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=5 * hour)))
        session.register_table("t", data)
        check(session, "select service, count(*) as n from t group by service", spark)
        assert session.stats[0].stored_rows <= 4


def test_large_state_goes_to_files(spark):
    data, cache = rows(spark), MemoryQueryCache()
    for hour in (5, 20, 99):
        config = QueryCacheConfig("t.ts", cache, driver_rows=3).with_override_now(START + timedelta(hours=hour))
        session = with_query_cache(spark, config)
        session.register_table("t", data)
        check(session, "select service, value, count(*) as n from t group by service, value", spark)
    assert next(iter(cache._entries.values()))[1].path


def test_types_of_temporal_columns(spark):
    for cast in ("date", "timestamp", "timestamp_ntz"):
        data, cache = rows(spark, late_nulls=False).withColumn("ts", F.col("ts").cast(cast)), MemoryQueryCache()
        for hour in (30, 45, 60):
            session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=hour)))
            session.register_table("t", data.where(F.col("ts") < F.lit(START + timedelta(hours=hour)).cast("timestamp_ntz")))
            check(session, "select service, count(*) as n, sum(value) as s from t group by service", spark)
    session = with_query_cache(spark, QueryCacheConfig("t.value", MemoryQueryCache()), log := MemoryLog())
    session.register_table("t", rows(spark))
    check(session, "select count(*) as n from t", spark)
    assert "is no date or timestamp" in str(log.history()) and not session.stats


def test_scan_reads_only_new_rows(spark, tmp_path):
    rows(spark, late_nulls=False).write.parquet(str(tmp_path / "t"))
    data, cache = spark.read.parquet(str(tmp_path / "t")), MemoryQueryCache()
    config = QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=20))
    session = with_query_cache(spark, config)
    session.register_table("t", data)
    session.sql("select count(*) as n, avg(value) as m from t where value > 3")
    from tidemark.operators.maintain import fresh_rows
    from tidemark.plans import catalyst
    from tidemark.plans.planner import Planner

    planner = Planner(spark, config, session._tables)
    (found,) = planner.candidates(catalyst.analyzed(spark.sql("select count(*) as n, avg(value) as m from t where value > 3")))
    plan = fresh_rows(found.aggregation, cache.entry(found.fingerprint).timestamp())._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(ts,2024-01-01T20:00" in pushed and "IsNull(ts)" in pushed


def test_fingerprints_tell_queries_apart(spark, tmp_path):
    rows(spark, 20).write.parquet(str(tmp_path / "x"))
    rows(spark, 20).write.parquet(str(tmp_path / "y"))
    config = QueryCacheConfig("t.ts", MemoryQueryCache())
    session = with_query_cache(spark, config)
    keys = set()
    for name in ("x", "y"):
        spark.read.parquet(str(tmp_path / name)).createOrReplaceTempView("t")
        for sql in ("select count(*) from t", "select count(value) from t", "select count(*) from t where value > 1", "select count(*) from t where value > 2", "select service, count(*) from t group by service"):
            keys.add(session.explain(sql).split("key: ")[1].split()[0])
    many = ", ".join(f"sum(value + {i})" for i in range(40))
    keys.add(session.explain(f"select {many}, sum(value + 100) from t").split("key: ")[1].split()[0])
    keys.add(session.explain(f"select {many}, sum(value + 101) from t").split("key: ")[1].split()[0])
    assert len(keys) == 12


def test_explain_writes_nothing_and_analyze_does(spark):
    cache = MemoryQueryCache()
    session = with_query_cache(spark, QueryCacheConfig("t.ts", cache))
    session.register_table("t", rows(spark))
    assert "miss" in session.explain("select count(*) from t") and len(cache) == 0
    assert "not cached" in session.explain("select count(*) from t where ts < now()")
    assert "hit=False" in session.explain_analyze("select count(*) from t") and len(cache) == 1
    assert "hit, rows with t.ts >=" in session.explain("select count(*) from t", verbose=True)


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("select date_trunc('day', ts), date_trunc('hour', ts), count(*) from t group by 1, 2", "two buckets of time"),
        ("select count(*) from t where ts < now()", "reads the clock"),
        ("select count(*) from t where ts > now() - interval 1 day", "lower bound moves with the clock"),
        ("select count(*) from (select * from t limit 5)", "no table scan"),
        ("select sum(value) from t where rand() < 2", "not deterministic"),
        ("select first(value) from t", "no state that merges"),
        ("select listagg(service) within group (order by value) from t", "no state that merges"),
        ("select try_sum(value) from t", "no state that merges"),
        ("select count(*) from u", "default temporal column"),
        ("select count(*) from t join u using (value)", "no table scan"),
        ("select count(*) from t where ts > now() - interval 1 day and ts > current_date()", "several lower bounds"),
        ("select count(*) from t where value > (select max(value) from u)", "subquery"),
        ("select date_trunc('day', ts) as d, count(*) from t where ts > now() - interval 1 day or value > 3 group by 1", "inside Or"),
        ("select date_trunc('day', ts) as d, count(*) from t where ts > now() - interval 1 day group by cube (1)", "moves with the clock"),
    ],
)
def test_refusals_are_logged_and_harmless(spark, sql, reason):
    session = with_query_cache(spark, QueryCacheConfig("t.ts", MemoryQueryCache()).with_group_by_function("date_trunc"), log := MemoryLog())
    session.register_table("t", rows(spark))
    rows(spark, 10).select("value").createOrReplaceTempView("u")
    df = session.sql(sql)
    df.collect()
    assert not session.stats and reason in str(log.history())


def test_changed_state_is_a_miss(spark):
    cache = MemoryQueryCache()
    config = QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=9))
    session = with_query_cache(spark, config)
    session.register_table("t", rows(spark))
    session.sql("select count(*) as n from t")
    (key,) = cache._entries
    cache.entry(key).put(1, a_state(1))
    check(session, "select count(*) as n from t", spark)
    assert not session.stats[0].hit


def test_demo_figures(spark):
    """One row a second, values that restart with the second batch; the expected figures follow from arithmetic."""
    cut, end = START + timedelta(seconds=62_299), START + timedelta(days=1)
    batch = lambda begin, n: spark.range(n).select((F.lit(begin).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"), F.element_at(F.array(*map(F.lit, ["foo", "bar", "baz", "qux", "quux"])), (F.col("id") % 5 + 1).cast("int")).alias("service"), F.col("id").alias("value"))
    sql, cache = "select round(avg(value), 2) as mean, count(*) as n from records where value > 1", MemoryQueryCache()
    config = QueryCacheConfig("records.timestamp", cache).with_group_by_function("date_trunc")
    cold = with_query_cache(spark, config.with_override_now(cut))
    cold.register_table("records", batch(START, 62_299))
    assert [tuple(r) for r in cold.sql(sql).collect()] == [(31150.0, 62297)]
    warm = with_query_cache(spark, config)
    warm.register_table("records", batch(START, 62_299).union(batch(cut, 24_101)))
    assert [tuple(r) for r in warm.sql(sql).collect()] == [(25822.59, 86396)] and warm.stats[0].hit
    assert (end - cut).total_seconds() == 24_101


def test_explicit_interface(spark):
    data, cache = rows(spark), MemoryQueryCache()
    for hour in (10, 40):
        got, stats = cached_agg(data, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=hour)), "ts", {"s": "service"}, {"m": ("avg", "value"), "n": ("count", "value"), "d": ("max", "weight")}, "t")
        want = data.groupBy(F.col("service").alias("s")).agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.max("weight").alias("d"))
        assert all(same(x, y) for r, s in zip(sorted(got.collect(), key=str), sorted(want.collect(), key=str), strict=True) for x, y in zip(r, s, strict=True))
    assert stats.hit
    with pytest.raises(ValueError):
        cached_agg(data, QueryCacheConfig("t.ts", cache), "value", {}, {"n": ("count", "value")})


def test_moments_of_shifted_values(spark):
    """A mean far larger than the deviations, in three runs: sums of squares would cancel."""
    random.seed(3)
    data = spark.createDataFrame([(START + timedelta(minutes=i), random.choice("ab"), random.expovariate(0.02), random.gauss(0, 3)) for i in range(3000)], "ts timestamp_ntz, k string, x double, y double").cache()
    calls = ["stddev_samp(x + 1e9)", "var_pop(x + 1e9)", "corr(x + 1e8, y - 1e8)", "covar_samp(x + 1e8, y + x)", "regr_slope(x + 1e8, x * 2 + y + 1e8)", "regr_r2(x + 1e8, x + y)", "skewness(x + 1e6)", "kurtosis(x + 1e6)", "kurtosis(x - 1e7)"]
    cache, sql = MemoryQueryCache(), f"select k, {', '.join(f'{c} as a{i}' for i, c in enumerate(calls))} from t group by k order by k"
    for minutes in (500, 1700, 3000):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(minutes=minutes)))
        session.register_table("t", data.where(F.col("ts") < F.lit(START + timedelta(minutes=minutes)).cast("timestamp_ntz")))
        for got, want in zip(session.sql(sql).collect(), spark.sql(sql).collect(), strict=True):
            assert got.k == want.k and [got[i] for i in range(1, 10)] == pytest.approx([want[i] for i in range(1, 10)], rel=2e-4)
    assert session.stats[0].hit


@pytest.mark.parametrize("group", ["", "group by service"])
def test_values_beside_all_other_aggregates_in_the_driver(spark, group):
    """State without lists, so that it stays in the driver: rows of values have nulls in the columns of the others."""
    data, cache = rows(spark), MemoryQueryCache()
    calls = [a for a in AGGREGATES if "collect_list" not in a and "listagg" not in a]
    for hour in (5, 20, 99):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data)
        check(session, f"select {', '.join(f'{a} as a{i}' for i, a in enumerate(calls))} from t {group}", spark)
    assert session.stats[0].hit and next(iter(cache._entries.values()))[1].table is not None


@pytest.mark.parametrize("group", ["", "group by service"])
def test_values_go_to_files(spark, group):
    """Exact values are rows of state: beyond the driver's bound they are in files, and merge there."""
    data, cache = rows(spark), MemoryQueryCache()
    sql = f"select count(distinct value) as d, median(weight) as m, mode(value) as c, sum(distinct value) as s, count(*) as n, max(value) as high from t {group}"
    for hour in (5, 20, 99):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache, driver_rows=20).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data.where("value is null or value not in (select 1000)"))
        session.register_table("t", data)
        got, want = session.sql(sql), spark.sql(sql.replace("mode(value)", "mode(value, true)"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert session.stats[0].hit and session.stats[0].stored_rows > 20
    assert next(iter(cache._entries.values()))[1].path


def test_bytes_bound_what_the_driver_holds(spark):
    data, cache = rows(spark), MemoryQueryCache()
    session = with_query_cache(spark, QueryCacheConfig("t.ts", cache, driver_bytes=1 << 15))
    session.register_table("t", data)
    for sql in ("select service, sort_array(collect_list(value)) as v from t group by service", "select value, approx_count_distinct(service) as n from t group by value"):
        check(session, sql, spark)
        check(session, sql, spark)
    assert all(state.path for _, state in cache._entries.values())


@pytest.mark.parametrize(("driver_rows", "reads"), [(50_000, 1), (5, 1)])
def test_each_row_is_read_once(spark, driver_rows, reads):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = rows(spark, 300, late_nulls=False)
    config = QueryCacheConfig("t.ts", MemoryQueryCache(), driver_rows=driver_rows).with_override_now(START + timedelta(days=9))
    got, stats = cached_agg(data.mapInArrow(look, data.schema), config, "ts", {"value": "value"}, {"n": ("count", F.lit(1))}, "t")
    assert seen.value == 300 * reads and got.count() == stats.stored_rows > 5


@pytest.mark.parametrize("driver_rows", [50_000, 2])
def test_unchanged_files_are_not_read(spark, tmp_path, driver_rows):
    path, cache = str(tmp_path / "t"), MemoryQueryCache()
    rows(spark).write.parquet(path)
    sql = "select service, count(*) as n, count(distinct value) as d from t group by service"
    for clock, scanned in ((20, True), (30, driver_rows == 2), (99, True)):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache, driver_rows=driver_rows).with_override_now(START + timedelta(hours=clock)))
        if clock == 99:
            rows(spark, 5, seed=9).withColumn("ts", F.col("ts") + F.expr("interval 4 days")).write.mode("append").parquet(path)
        session.register_table("t", spark.read.parquet(path))
        check(session, sql, spark)
        assert session.stats[0].scanned == scanned
    session.register_table("t", spark.read.parquet(path).where("value > 3"))  # the same files under another plan
    session.sql(sql)
    assert session.stats[0].scanned


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "timestamp"])
def test_columns_show_the_time_of_the_session_zone(spark, zone, kind):
    """Rows are written by the zone's own clock, up to the moment of each run."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        base = spark.range(200).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("at"), (F.col("id") % 7).alias("value"))
        cache = MemoryQueryCache()
        for hour in (50, 51, 60, 120, 200):
            now = datetime(2024, 1, 1) + timedelta(hours=hour)
            session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_override_now(now))
            session.register_table("t", base.where(F.col("at") < F.timestamp_seconds(F.lit(1_704_067_200 + hour * 3600))).withColumn("ts", F.col("at").cast(kind)).drop("at"))
            check(session, "select value, count(*) as n from t group by value", spark)
            assert session.stats[0].hit == (hour > 50) and (kind == "date" or session.stats[0].stored)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def recent(spark, n=600):
    """A row each 10 minutes up to now."""
    start = datetime.now() - timedelta(minutes=10 * n)
    return spark.createDataFrame([(start + timedelta(minutes=10 * i), "ab"[i % 2], i % 13) for i in range(n)] + [(None, "a", 1)], "ts timestamp_ntz, service string, value long")


@pytest.mark.parametrize("unit", ["day", "HOUR", "week"])
@pytest.mark.parametrize("bound", ["ts > now() - interval 30 hours", "cast(now() as timestamp_ntz) - interval 31 hours <= ts", "ts >= current_date() - interval 1 day"])
def test_moving_bound_over_buckets(spark, unit, bound):
    data, cache = recent(spark), MemoryQueryCache()
    sql = f"select date_trunc('{unit}', ts) as b, service, count(*) as n, sum(value) as s, count(distinct value) as d from t where {bound} and value > 2 group by 1, 2"
    for back in (2000, 100, 0):
        now = datetime.now() - timedelta(minutes=back)
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache).with_group_by_function("date_trunc").with_override_now(now))
        session.register_table("t", data.where((F.col("ts") < F.lit(now).cast("timestamp_ntz")) | F.col("ts").isNull()))
        check(session, sql, spark)
        assert len(session.stats) == 1 and session.stats[0].hit == (back < 2000)
    plan = session.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    assert "ts" in plan


def test_outer_joins_with_immutable_tables(spark):
    spark.createDataFrame([(i, f"n{i % 3}") for i in range(0, 40, 2)], "value long, name string").createOrReplaceTempView("names")
    data, cache = rows(spark), MemoryQueryCache()
    texts = {
        "select name, count(*) as n, sum(t.value) as s from t left join names using (value) group by name": True,
        "select name, count(*) as n from names right join t on names.value = t.value group by name": True,
        "select count(*) as n from t left anti join names using (value)": True, "select count(*) as n from t left semi join names using (value)": True,
        "select name, count(*) as n from names left join t on names.value = t.value group by name": False, "select count(*) as n from t full outer join names using (value)": False,
    }
    for hour in (10, 99):
        session = with_query_cache(spark, QueryCacheConfig("t.ts", cache, immutable_joins=True).with_override_now(START + timedelta(hours=hour)))
        session.register_table("t", data)
        for sql, kept in texts.items():
            check(session, sql, spark)
            assert bool(session.stats) == kept


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace

    from tidemark.sources.folders import shared_folder

    settings = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=settings.get, set=settings.__setitem__), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(spark)
    settings["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_folder(spark) == "hdfs://x/y"
    settings.clear()
    spark.sparkContext.master = "local[4]"
    assert shared_folder(spark).startswith("file:///") and settings
