"""Counts by windows of event time, kept by the stream itself: its own form of a bucketed aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import own_folder


def windowed_counts(stream: DataFrame, temporal: str, width: str, watermark: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling windows, or with ``slide`` by sliding ones; rows later than the watermark are dropped once it has passed."""
    return stream.withWatermark(temporal, watermark).groupBy(F.window(temporal, width, slide), *keys).count()


def session_counts(stream: DataFrame, temporal: str, gap: str, watermark: str, *keys: str) -> DataFrame:
    """Counts by sessions, which end where no row of their keys follows within ``gap``."""
    return stream.withWatermark(temporal, watermark).groupBy(F.session_window(temporal, gap), *keys).count()


def _streamed(count: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Events come in three files, each of every third day; every batch writes all windows anew."""
        rows, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), own_folder(spark, "windows")
        rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
        for part in range(3):
            rows.where(F.pmod(F.dayofyear("ts"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        counted = count(stream)
        write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
        query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        window = F.col(counted.columns[0])
        out = spark.read.schema(counted.schema).parquet(f"{folder}/out")
        return out.select(window["start"].cast("timestamp_ntz").alias("start"), window["end"].cast("timestamp_ntz").alias("end"), "event_type", F.col("count").alias("n"))

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_tumbling": _streamed(lambda s: windowed_counts(s, "ts", "6 hours", "40 days", "event_type")),
        "stream_sliding": _streamed(lambda s: windowed_counts(s, "ts", "6 hours", "40 days", "event_type", slide="3 hours")),
        "stream_session": _streamed(lambda s: session_counts(s, "ts", "20 minutes", "40 days", "event_type")),
    }


def oracle_sql() -> dict[str, str]:
    bucket = "time_bucket(interval '{}', ts, timestamp '1970-01-01 00:00:00')"
    sliding = f"select unnest([b, b - interval 3 hours]) as start, event_type from (select {bucket.format('3 hours')} as b, event_type from events)"
    return {
        "stream_tumbling": f'select {bucket.format("6 hours")} as start, {bucket.format("6 hours")} + interval 6 hours as "end", event_type, count(*) as n from events group by 1, 2, 3',
        "stream_sliding": f'select start, start + interval 6 hours as "end", event_type, count(*) as n from ({sliding}) group by 1, 2, 3',
        "stream_session": """
            select min(ts) as start, max(ts) + interval 20 minutes as "end", event_type, count(*) as n
            from (select ts, event_type, sum(opens) over (partition by event_type order by ts) as number
                  from (select ts, event_type, case when ts < lag(ts) over (partition by event_type order by ts) + interval 20 minutes then 0 else 1 end as opens from events))
            group by event_type, number""",
    }
