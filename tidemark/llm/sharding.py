"""Contiguous shards of equal bytes, cut on global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions


def byte_shards(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus ``overhead``. Rows are ordered by doc_id (null first), then
    CRC, size and a hash of the text; rows equal in all of these are interchangeable. A row goes to the shard
    whose equal share of all bytes holds the middle of the row's own bytes, so shards are contiguous in that
    order and differ from the share by less than one row. slot numbers a shard's rows from 0. law is 'bytes' and
    grown_shard is null. Other columns are ignored; an empty table gives an empty result. Twice the bytes of all times
    ``shards`` must be below 2 ** 63, which is 46,000 shards of 100 TB.

    Rows are dealt by ranges once; only each range's totals meet in one task, never the rows. Rows that share a
    doc_id, however many, are spread over ranges by the later keys and a row number.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    order = ["doc_id", "text_crc32", "size", "h__", "n__"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h__"), F.monotonically_increasing_id().alias("n__"),
    )
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("range__", F.spark_partition_id())
    dealt = scratch.save(dealt)
    totals = dealt.groupBy("range__").agg(F.sum("size").alias("bytes__"), F.count("*").alias("rows__"))
    before = W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("range__").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = totals.select("range__", F.coalesce(F.sum("bytes__").over(before), zero).alias("bytes_before"), F.coalesce(F.sum("rows__").over(before), zero).alias("rows_before"), F.sum("bytes__").over(everything).alias("total"))
    inside = W.partitionBy("range__").orderBy(*order)
    placed = dealt.withColumn("start", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("row", F.row_number().over(inside).cast("long") - 1)
    placed = placed.join(F.broadcast(totals), "range__")  # one row for each shuffle partition
    shard = F.expr(f"({shards} * (2 * (bytes_before + start) + size)) div (2 * total)")
    placed = placed.select("doc_id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("row")).alias("row"))
    placed = scratch.save(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
