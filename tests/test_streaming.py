from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import MemoryQueryCache, ParquetQueryCache, QueryCacheConfig
from tidemark.streaming.feeder import StateFeeder
from tidemark.streaming.windows import windowed_counts

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, kind string, value long"


def rows(spark, low, high):
    return spark.createDataFrame([(START + timedelta(minutes=i), "ab"[i % 2], i) for i in range(low, high)], SCHEMA)


def test_feeder_adds_each_batch_once(spark):
    feeder = StateFeeder(QueryCacheConfig("t.ts", MemoryQueryCache()), "ts", {"kind": "kind"}, {"n": ("count", F.lit(1)), "s": ("sum", "value")}, "t")
    feeder.add(rows(spark, 0, 10), 0)
    feeder.add(rows(spark, 10, 30), 1)
    feeder.add(rows(spark, 10, 30), 1)  # repeated after a failure
    feeder.add(rows(spark, 30, 30), 2)  # empty
    out, stats = feeder.result(rows(spark, 0, 50), 2_000_000_000_000_000)
    assert stats.hit and sorted(map(tuple, out.collect())) == [("a", 25, sum(range(0, 50, 2))), ("b", 25, sum(range(1, 50, 2)))]


def test_stream_of_files(spark, tmp_path):
    rows(spark, 0, 40).write.parquet(str(tmp_path / "in/1"))
    rows(spark, 40, 60).write.parquet(str(tmp_path / "in/2"))
    feeder = StateFeeder(QueryCacheConfig("t.ts", ParquetQueryCache(spark, f"file://{tmp_path}/state")), "ts", {"kind": "kind"}, {"n": ("count", F.lit(1))}, "t")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "in/*"))
    feeder.start(stream, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    out, stats = feeder.result(rows(spark, 0, 80), 2_000_000_000_000_000)
    assert stats.hit and sorted(map(tuple, out.collect())) == [("a", 40), ("b", 40)]


def test_windowed_counts(spark, tmp_path):
    rows(spark, 0, 120).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, value long").parquet(str(tmp_path / "in"))
    counts = windowed_counts(stream, "ts", "1 hour", "10 minutes", "kind")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["count"] for r in spark.table("counts").collect()] == [30] * 4


@pytest.mark.parametrize("lateness", [0, 15 * 60_000_000])
def test_batches_with_lateness_and_disorder(spark, lateness):
    config = QueryCacheConfig("t.ts", MemoryQueryCache(), allowed_lateness=lateness)
    feeder = StateFeeder(config, "ts", {"kind": "kind"}, {"n": ("count", F.lit(1)), "s": ("sum", "value")}, "t")
    whole = rows(spark, 0, 80)
    want = [("a", 40, sum(range(0, 80, 2))), ("b", 40, sum(range(1, 80, 2)))]
    for number, (low, high) in enumerate([(0, 10), (40, 60), (10, 40)]):
        feeder.add(rows(spark, low, high), number)
    for now in (2_000_000_000_000_000, 2_000_000_000_000_001):
        out, stats = feeder.result(whole, now)
        assert stats.hit and sorted(map(tuple, out.collect())) == want
    feeder.add(rows(spark, 60, 70), 3)  # a result in between has left the state as it was
    out, stats = feeder.result(whole, 2_000_000_000_000_000)
    assert stats.hit and stats.lower_bound > 0 and sorted(map(tuple, out.collect())) == want


def test_batches_of_dates(spark):
    def days(low, high):
        return spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i // 3), i) for i in range(low, high)], "day date, value long")

    feeder = StateFeeder(QueryCacheConfig("t.day", MemoryQueryCache()), "day", {}, {"n": ("count", F.lit(1)), "s": ("sum", "value")}, "t")
    for number, (low, high) in enumerate([(0, 7), (7, 14), (14, 20)]):
        feeder.add(days(low, high), number)
    out, stats = feeder.result(days(0, 30), 2_000_000_000_000_000)
    assert stats.hit and out.collect() == [(30, sum(range(30)))]


@pytest.mark.parametrize("lateness", [0, 15 * 60_000_000])
def test_restarts_go_on_where_the_last_driver_stopped(spark, tmp_path, lateness):
    """Each batch is added by a feeder and a store of a new driver; batches that had been added are repeated, and come out of order."""

    def feeder():
        cache = ParquetQueryCache(spark, f"file://{tmp_path}/state")
        return StateFeeder(QueryCacheConfig("t.ts", cache, allowed_lateness=lateness), "ts", {"kind": "kind"}, {"n": ("count", F.lit(1)), "s": ("sum", "value"), "d": ("mode", "value")}, "t")

    whole = rows(spark, 0, 80)
    for number, (low, high) in [(0, (30, 60)), (1, (0, 10)), (1, (0, 10)), (0, (30, 60)), (2, (10, 30)), (2, (10, 30))]:
        feeder().add(rows(spark, low, high), number)
    out, stats = feeder().result(whole, 2_000_000_000_000_000)
    assert stats.hit and stats.lower_bound > 0 and sorted(map(tuple, out.collect())) == [("a", 40, sum(range(0, 80, 2)), 0), ("b", 40, sum(range(1, 80, 2)), 1)]


def test_stream_needs_a_store_that_survives(spark, tmp_path):
    feeder = StateFeeder(QueryCacheConfig("t.ts", MemoryQueryCache()), "ts", {}, {"n": ("count", F.lit(1))}, "t")
    rows(spark, 0, 4).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="outlives"):
        feeder.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), availableNow=True)
