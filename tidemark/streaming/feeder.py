"""Feeds stored state from a stream: each micro-batch adds its partial state, so a later query reads only the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType

from ..config import QueryCacheConfig
from ..operators.maintain import bound_literal, column_time
from ..session import cached_agg, explicit
from ..sources.cache import ParquetQueryCache
from ..sources.folders import delete, own_folder


class StateFeeder:
    """Keeps the state of one explicit aggregation up to date with a stream of new rows.

    Batches are added whatever their order. The stored time is one microsecond after the latest row seen, less
    ``allowed_lateness``, and a whole day where times are dates; it is the caller's promise, as everywhere, that rows
    not yet fed have later times. Rows of a batch at or after that time are held back in files and added with a later
    batch, as a query reads them again.

    What the feeder has to know is stored with the state, in one write: the number of the last batch, so that a batch
    that the stream repeats after a failure is added once, and where the rows held back are. A feeder in a new driver
    goes on from there, if the store is durable. Where the store had state of queries before the first batch, rows
    older than it count as known.
    """

    def __init__(self, config: QueryCacheConfig, temporal: str, keys: dict, aggs: dict, name: str):
        self.config, self.temporal, self.spec = config, temporal, {"keys": keys, "aggs": aggs, "name": name}

    def add(self, batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[self.temporal].dataType
        entry = self.config.cache.entry(explicit(batch, self.temporal, **self.spec).fingerprint)
        known = (entry.get().note if entry.occupied() else None) or {}
        if number <= known.get("batch", -1):
            return
        latest = batch.agg(F.max(F.unix_micros(F.col(self.temporal).cast("timestamp")))).first()[0]
        if latest is None:
            return
        latest, old = max(latest, known.get("latest", latest)), known.get("held")
        rows = batch if old is None else batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        config = self.config.with_override_now(latest + 1)
        bound = column_time(spark, config.clock(), kind)
        # Written before the state is stored, so that a batch that fails here can be repeated.
        held = None
        if bound <= column_time(spark, latest, kind) or isinstance(kind, DateType):
            held = f"{self.config.cache.folder}/held-{uuid.uuid4().hex}" if self.config.cache.durable else own_folder(spark, "held")
            rows.where(F.col(self.temporal) >= bound_literal(bound, kind)).write.mode("append").parquet(held)
        mode = {"mode": "feed", "since": known["since"]} if known else {}
        note = lambda stats: {"batch": number, "latest": latest, "held": held, "since": known["since"] if known else stats.lower_bound}
        cached_agg(rows, config, self.temporal, **self.spec, **mode, note=note)
        if old is not None:
            delete(spark, old)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feeds a stream. The store must be durable, as the checkpoint is: else a restart would go on without what came before."""
        if not self.config.cache.durable:
            raise ValueError("a stream's state needs a store that outlives the driver, such as ParquetQueryCache")
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "10 seconds"}).start()

    def result(self, rows: DataFrame, now: int):
        """The aggregation over all of ``rows``, of which only those after the fed ones are read; the state stays as it was fed."""
        return cached_agg(rows, self.config.with_override_now(now), self.temporal, **self.spec, mode="read")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before a cut arrive as a stream of several batches, out of order and with a restart of the feeder in between.

    The final result reads the rest from the table.
    """
    path = f"{sf_dir}/events.parquet"
    rows, cut = spark.read.parquet(path), F.lit("2024-01-20").cast("timestamp_ntz")
    early, folder = rows.where(F.col("ts") < cut), own_folder(spark, "feed")
    cache, spec = ParquetQueryCache(spark, f"{folder}/state"), ("ts", {"event_type": "event_type"}, {"n": ("count", F.lit(1)), "total": ("sum", "value"), "high": ("max", "value")}, "events")
    feeder = lambda: StateFeeder(QueryCacheConfig("events.ts", cache, allowed_lateness=3_600_000_000), *spec)
    for part in (2, 0, 1):  # three files, the last rows first
        own = early.where(F.pmod(F.dayofyear("ts"), F.lit(3)) == part)
        own.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        feeder().start(stream, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    out, stats = feeder().result(rows, 1_900_000_000_000_000)
    assert stats.hit and stats.lower_bound > 0
    return out.withColumn("total", F.round("total", 2))
