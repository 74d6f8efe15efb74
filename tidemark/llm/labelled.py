"""A bounded, repeatable sample of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id) -> F.Column:
    """True for the documents that classifiers never learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def excerpt(text: F.Column, most: int, pieces: int = 8) -> F.Column:
    """Texts of up to ``most`` characters as they are; of longer ones as many characters, in pieces spread evenly from start to end."""
    n, size = F.char_length(text), most // pieces
    spread = [F.substr(text, (F.lit(i) * (n - size) / (pieces - 1)).cast("int") + 1, F.lit(size)) for i in range(pieces)]
    return F.when(n > most, F.concat_ws(" ", *spread)).otherwise(text)


def sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, most_chars: int | None = None) -> DataFrame:
    """(doc_id, y, text) for at most ``positives`` + ``negatives`` labelled documents that are not held out.

    The rows of each class with the smallest hash of doc_id are taken, so the sample does not depend on how the
    tables are stored. Labels that are null or disagree for a doc_id are left out; of several texts of a doc_id
    the smallest is taken, and of a text longer than ``most_chars`` an excerpt. The bounds make the ids safe to
    broadcast and the sample safe to collect.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", "y")
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    ids = known.where("y = 1").orderBy(*order).limit(positives).union(known.where("y = 0").orderBy(*order).limit(negatives))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # at most positives + negatives rows
    if most_chars is not None:
        found = found.withColumn("text", excerpt(F.col("text"), most_chars))
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
