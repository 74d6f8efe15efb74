"""A training-data pipeline: quality, repeated lines, near-duplicates, benchmark leaks, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lines, quality, shingles
from tidemark.llm.common import Scratch, small_or_shuffled, table


#: Chunks and words that the last stage keeps for reuse; the executors are fuller here than where texts are only encoded.
KEPT_CHUNKS, KEPT_PIECES = 4_000, 50_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labelled ones among ``docs``.

    A null text counts as empty and is judged like any other; rows that repeat a doc_id, or have none, are judged one
    by one. With fewer than 20 labelled documents, or labels of one class, all have the same score and stay or go together.
    An empty table gives an empty result; other columns come back as they are.
    """
    return quality.good_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line repeats; a document that loses all it had is dropped.

    n_chars, where there is such a column, follows the text. A null or empty text, and one of blank lines, stays as
    it is; a document without doc_id comes after all others; lines at the same place, in rows that repeat a doc_id, do
    not repeat each other. An empty table gives an empty result; other columns come back as they are.
    """
    names = docs.columns
    got = lines.dedup_lines(docs.withColumn("whole__", F.struct(*(F.col(f"`{c}`") for c in names))), keep=("whole__",))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) == "")
    got = got.where(~F.coalesce(emptied, F.lit(False)))

    def column(name: str) -> F.Column:
        old = F.col("whole__").getField(name)
        if name == "text":
            return F.col("kept_text").alias(name)
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(old).alias(name)
        return old.alias(name)

    return got.select(*(column(c) for c in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows that share a doc_id are one document.

    Documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. A SimHash of 64 bits
    differs in about ten bits at that similarity, too many to look up, so candidates come from MinHash bands. Texts
    without words, null included, are near-duplicates of each other. Rows without doc_id stay. An empty table gives an
    empty result; other columns come back as they are.
    """
    classes = shingles.near_duplicates(docs.select("doc_id", "text"))
    return _without(docs, F.col("doc_id").cast("long"), classes.where("doc_id != component_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of eight words of a benchmark item occurs, or a whole shorter item.

    Texts without words hold none and stay, null included; rows that repeat a doc_id, or have none, are judged one by
    one. Without benchmark items all rows stay. An empty table gives an empty result; other columns come back as they
    are. Rows are told apart by a 64-bit hash of doc_id and text.
    """
    name = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    judged = decontaminate.decontaminate(docs.select(name.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), least_items=1)
    return _without(docs, name, judged.where("contaminated").select("doc_id"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document, as the tokenizer encodes its whole text.

    A null or empty text has no tokens; repeated rows, and rows without doc_id, come back one by one; an empty table
    gives an empty result; other columns are left out.
    """
    got = bpe.encode(docs, kept_chunks=KEPT_CHUNKS, kept_pieces=KEPT_PIECES)
    return got.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _without(docs: DataFrame, key: F.Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the only column of ``gone``; rows with a null key stay."""
    other = "gone"
    while any(other == c.lower() for c in docs.columns):
        other += "_"
    gone = small_or_shuffled(Scratch(docs.sparkSession).save(gone.distinct().toDF(other)))
    return docs.join(gone, key == gone[other], "left_anti")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", tokenize),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written and read again before the next stage."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
