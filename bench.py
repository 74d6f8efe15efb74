"""Times the headline queries: plain Spark, the cold run, and warm runs with 5 %, 1 % and no new rows. One JSON line.

``large`` has lineitem BENCH_COPIES times over, written in date order, as tables that grow in time are: there the scan counts.
"""

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import MemoryQueryCache, QueryCacheConfig, with_query_cache

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
COPIES = int(os.environ.get("BENCH_COPIES", "40"))

#: Name: (table, temporal column, query).
QUERIES = {
    "global_avg_count": ("events", "ts", "select round(avg(value), 2) as avg_value, count(*) as n from events where value > 1"),
    "hourly_bucket": ("events", "ts", "select date_trunc('hour', ts) as time_bucket, avg(value) as avg_value, min(value) as min_value, max(value) as max_value from events where ts > timestamp '2000-01-01 00:00:00' group by 1 order by 1 desc"),
    "lineitem_q1": (
        "lineitem", "l_shipdate",
        "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as sum_disc_price, avg(l_quantity) as avg_qty, count(*) as n from lineitem group by 1, 2 order by 1, 2",
    ),
    "distinct_users": ("events", "ts", "select event_type, count(distinct user_id) as users, stddev(value) as sd from events group by event_type"),
}


def timed(run) -> float:
    begin = time.perf_counter()
    run()
    return time.perf_counter() - begin


def measured(spark: SparkSession, name: str, rows, table: str, column: str, sql: str) -> dict[str, float]:
    """Seconds of each kind of run of one query, the median of RUNS."""
    out = {}
    low, high = rows.agg(F.min(F.unix_micros(F.col(column).cast("timestamp"))), F.max(F.unix_micros(F.col(column).cast("timestamp")))).first()
    ends = {"cold": None, "warm_5pct": low + (high - low) * 95 // 100, "warm_1pct": low + (high - low) * 99 // 100, "warm_empty": high + 1}

    def session(cache, now):
        got = with_query_cache(spark, QueryCacheConfig(f"{table}.{column}", cache).with_group_by_function("date_trunc").with_override_now(now))
        # The files as they were then hold the rows before that time only.
        got.register_table(table, rows if now is None or now > high else rows.where(F.col(column) < F.timestamp_micros(F.lit(now)).cast("timestamp_ntz")))
        return got

    session(MemoryQueryCache(), high + 2).sql(sql).collect()  # compile everything once
    rows.createOrReplaceTempView(table)
    out[f"{name}.plain"] = median(timed(lambda: spark.sql(sql).collect()) for _ in range(RUNS))
    for mode, cut in ends.items():
        times = []
        for _ in range(RUNS):
            cache = MemoryQueryCache()
            if cut is not None:
                session(cache, cut).sql(sql).collect()
            warm = session(cache, high + 2)
            times.append(timed(lambda: warm.sql(sql).collect()))
            if warm.stats[0].hit != (cut is not None):
                sys.exit(f"{name}, {mode}: the cache did not do as expected")
        out[f"{name}.{mode}"] = median(times)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    for name, (table, column, sql) in QUERIES.items():
        out |= measured(spark, name, spark.read.parquet(f"{SF}/{table}.parquet"), table, column, sql)
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).drop("copy")
        rows.repartitionByRange(2 * int(CPUS), "l_shipdate").sortWithinPartitions("l_shipdate").write.mode("overwrite").parquet(folder)
        large = spark.read.parquet(folder)
        for name, sql in {"lineitem_q1": QUERIES["lineitem_q1"][2], "distinct_parts": "select l_returnflag, count(distinct l_partkey) as parts, median(l_quantity) as med, stddev(l_extendedprice) as sd from lineitem group by 1"}.items():
            out |= measured(spark, f"large.{name}", large, "lineitem", "l_shipdate", sql)
    finally:
        shutil.rmtree(folder)
    out = {k: round(v, 4) for k, v in out.items()}
    total = round(sum(v for k, v in out.items() if k.endswith("warm_1pct") and not k.startswith("large.")), 4)
    print(json.dumps({"metric": "warm runs with 1 % new rows, all headline queries", "value": total, "unit": "sec", "queries": out, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
