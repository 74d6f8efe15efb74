"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training words, one row for each segment of documents: the
segment's terms, and for each term the sorted word positions. ``search`` takes each phrase of a test item,
intersects the position lists of its words, shifted by their offsets, from the rarest list on, and returns
exact matches (slop 0) or proximity matches, in which up to ``slop`` other words stand between the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches_of, slices, tidy, utf8

#: Word bytes: 0-9, a-z and all of 80-FF, after A-Z is lower-cased; every other byte separates.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Test items are collected in blocks of about so many bytes of text.
BLOCK_BYTES = 8 << 20
#: Texts and segments go to the Python workers in batches of about so many bytes; the JVM holds up to three times as much.
BATCH_BYTES = 8 << 20
#: Matches of a segment are merged so many at a time.
MERGED_ROWS = 10_000

INDEX = "segment string, doc_ids array<long>, n_words array<long>, terms array<binary>, ends array<long>, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def build_index(docs: DataFrame, terms: frozenset[bytes] | None = None) -> DataFrame:
    """A row for each segment of about 1 MB of text: its rows in order, with the postings of ``terms`` (all, if None).

    A posting is a word's number, counted over the segment's documents one after another.
    """
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}

    @tidy
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                counts, ids, local = [], [], {} if known is None else known
                for text in utf8(texts.slice(low, high - low)):
                    words = words_of(text)
                    counts.append(len(words))
                    if known is None:
                        for w in words:
                            local.setdefault(w, len(local))
                    ids.append(np.fromiter(map(local.get, words, repeat(-1)), dtype=np.int32, count=len(words)))
                ids = np.concatenate(ids)
                at = np.flatnonzero(ids >= 0)
                at = at[np.argsort(ids[at], kind="stable")].astype("<i4")
                used, lengths = np.unique(ids[at], return_counts=True)
                names = list(local)
                row = [uuid.uuid4().hex], [batch.column("doc_id").slice(low, high - low).to_pylist()], [counts], [[names[i] for i in used]], [np.cumsum(lengths)], [at.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(segments, INDEX)


_NAMES = ["segment", "doc_ids", "n_words", "terms", "ends", "postings"]
_TYPES = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]


def phrases(items: list[tuple[int, bytes]], window: int) -> dict[tuple[bytes, ...], list[int]]:
    """Every window of every item, with the ids of the items that have it; a shorter item is one window."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(tuple(words[i : i + window]), set()).add(item)
    return {p: sorted(ids) for p, ids in out.items()}


def intersect(lists: list[np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of a phrase, whose words have the sorted position lists ``lists``.

    slop 0: the lists, less their words' offsets, are intersected from the shortest on. Otherwise for each
    position of the first word the nearest later positions of the other words, in order, are taken.
    """
    if slop == 0:
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        begin = lists[order[0]] - order[0]
        for i in order[1:]:
            if not len(begin):
                break
            at = np.searchsorted(lists[i], begin + i)
            at[at == len(lists[i])] = 0
            begin = begin[lists[i][at] == begin + i]
        return begin, begin + len(lists) - 1
    begin, end = lists[0], lists[0]
    for later in lists[1:]:
        at = np.searchsorted(later, end, side="right")
        inside = at < len(later)
        begin, end = begin[inside], later[at[inside]]
    near = end - begin < len(lists) + slop
    return begin[near], end[near]


def _finder(items: list[tuple[int, bytes]], window: int, slop: int):
    """Rows of the index to matches of one block of test items."""
    grams = phrases(items, window)
    vocabulary = {t: i for i, t in enumerate(sorted({w for g in grams for w in g}))}
    owners = list(grams.values())
    table = np.full((len(grams), window), -1, dtype=np.int64)
    for i, g in enumerate(grams):
        table[i, : len(g)] = [vocabulary[w] for w in g]
    lengths = (table >= 0).sum(axis=1)

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = batch.column("ends")[i].values.to_numpy()
                begins = np.r_[0, ends[:-1]]
                sizes, place = np.zeros(len(vocabulary) + 1, dtype=np.int64), np.zeros(len(vocabulary) + 1, dtype=np.int64)
                sizes[-1] = 1  # the padding of short phrases
                for k, term in enumerate(batch.column("terms")[i].values.to_pylist()):
                    if (v := vocabulary.get(term)) is not None:
                        sizes[v], place[v] = ends[k] - begins[k], k
                postings = np.frombuffer(batch.column("postings")[i].as_py(), dtype="<i4").astype(np.int64)
                n_words = batch.column("n_words")[i].values.to_numpy()
                last_word = np.cumsum(n_words)
                found = []
                for g in np.flatnonzero((sizes[table] > 0).all(axis=1)):
                    lists = [postings[begins[place[v]] : ends[place[v]]] for v in table[g, : lengths[g]]]
                    begin, end = intersect(lists, slop)
                    if len(begin):
                        doc = np.searchsorted(last_word, begin, side="right")
                        same = end < last_word[doc]
                        found.append((np.full(same.sum(), g), doc[same], begin[same], end[same]))
                if found:
                    gram, doc, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
                    shift = (last_word - n_words)[doc]
                    ids = batch.column("doc_ids")[i].values.take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("segment")[i].as_py()] * len(doc)), pa.array(doc), ids, pa.array([owners[g] for g in gram], pa.list_(pa.int64())), pa.array(begin - shift), pa.array(end - shift)],
                        names=["segment", "ordinal", "doc_id", "item_ids", "first", "last"],
                    )

    return find


def search(index: DataFrame, items: list[tuple[int, bytes]], window: int = 8, slop: int = 0) -> DataFrame:
    """Matches of one block of test items: (segment, ordinal, doc_id, item_ids, first, last), a row for each occurrence of a window.

    ordinal is the document's number in its segment, first and last are word numbers in the document.
    """
    return index.mapInArrow(_finder(items, window, slop), "segment string, ordinal long, doc_id long, item_ids array<long>, first long, last long")


def _merged_search(index: DataFrame, items: list[tuple[int, bytes]], window: int, slop: int) -> DataFrame:
    """Merged spans of the matches of one block, found and merged by one worker; two steps would hold two for a task."""
    find = _finder(items, window, slop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in find(batches):
            yield from _merge(found.slice(low, MERGED_ROWS) for low in range(0, found.num_rows, MERGED_ROWS))

    return index.mapInArrow(run, "segment string, ordinal long, item_ids array<long>, spans array<struct<first:long,last:long>>")


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """The number of blocks of about ``block_bytes`` of test text, and the blocks, each collected when it is asked for."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def blocks():
        for b in range(n):
            got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow()
            yield list(zip(got.column("item_id").to_pylist(), utf8(got.column("text")), strict=True))

    return n, blocks()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, slop: int = 0, least_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    A document word is hit if an occurrence of a window of ``window`` consecutive item words covers it; n_items
    counts the items with such windows and contaminated is n_items >= ``least_items``. A null or empty text has
    no words; an item without id or words is ignored; equal item rows count once by their item_id; rows that
    repeat a doc_id, null included, are judged one by one. Without items nothing is hit. Other columns are
    ignored. Test text is collected in blocks of ``block_bytes``, one at a time; the index of the documents is read
    once for each block, and holds all terms if there are several blocks.
    """
    scratch = Scratch(docs.sparkSession)
    n_blocks, blocks = item_blocks(items, block_bytes)
    first = next(blocks)
    terms = frozenset(w for _, text in first for w in words_of(text)) if n_blocks == 1 else None
    with batches_of(docs.sparkSession, BATCH_BYTES):
        index = scratch.save(build_index(docs, terms))
    # Occurrences of a document lie in one segment, so each task reduces its own before anything is shuffled. The
    # matches of a block are written before the next block is collected.
    spans = None
    for block in chain([first], blocks):
        found = _merged_search(index, block, window, slop)
        with batches_of(docs.sparkSession, BATCH_BYTES):
            spans = scratch.save(found, spans._scratch_path) if spans is not None else scratch.save(found)
    merged = spans.groupBy("segment", "ordinal").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(x["first"] - 1, acc["last"]))).alias("n"),
            F.greatest(acc["last"], x["last"]).alias("last"),
        ),
        lambda acc: acc["n"],
    )
    hits = merged.select("segment", "ordinal", covered.alias("n_hit"), F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))).alias("names"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("pos", "doc"))
    rows = rows.select("segment", F.col("pos").cast("long").alias("ordinal"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").alias("n_words"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    n_items = F.size(names).cast("long")
    return rows.join(hits, ["segment", "ordinal"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"), names.alias("item_ids"),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences to merged spans: a row for each document of a batch."""
    for batch in batches:
        segment, ordinal = batch.column("segment").to_pylist(), batch.column("ordinal").to_pylist()
        first, last, items = batch.column("first").to_pylist(), batch.column("last").to_pylist(), batch.column("item_ids").to_pylist()
        docs: dict[tuple, tuple[set, list]] = {}
        for s, o, a, b, i in sorted(zip(segment, ordinal, first, last, items, strict=True)):
            ids, spans = docs.setdefault((s, o), (set(), []))
            ids.update(i)
            if spans and a <= spans[-1]["last"] + 1:
                spans[-1]["last"] = max(b, spans[-1]["last"])
            else:
                spans.append({"first": a, "last": b})
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in docs]), pa.array([k[1] for k in docs], pa.int64()), pa.array([sorted(v[0]) for v in docs.values()], pa.list_(pa.int64())), pa.array([v[1] for v in docs.values()], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                names=["segment", "ordinal", "item_ids", "spans"],
            )
