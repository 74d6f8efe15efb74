"""Near-duplicates by the similarity of their word shingles: candidates by SimHash and MinHash, each verified exactly.

Each set of shingles gets a SimHash, and those that differ in up to ``radius`` bits are found as in ``simhash``. At a
similarity of 0.8 a SimHash differs in about ten bits, too many to look up, so a set gets ``bands`` keys of ``rows``
minima each besides. Sets with close SimHashes or a common key form candidate groups; inside a group every set is
compared with all that are not yet linked to it, by the exact Jaccard similarity of the whole sets. Only the sets of
candidates are shuffled, each once unless its group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, Scratch, local_forest, shuffle_partitions, slices, small_or_shuffled, sorted_runs, spread, tidy, utf8
from .components import connected_components
from .simhash import close_links, of_hashes

#: Shingles whose minima are taken at once.
_BLOCK = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; a text of fewer words than ``width`` is one shingle, without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    n, used = max(1, len(words) - width + 1), min(width, len(words))
    factors = np.random.default_rng(width).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.full(n, used, dtype=np.uint64)
    for i in range(used):
        sums += hashes[i : i + n] * factors[i]
    return np.unique(_mixed(sums))


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band, from the minima of ``rows`` hash functions; no keys for the empty set."""
    if not len(shingles) or not bands:
        return np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng([bands, rows])
    factors = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    low, least = shingles.astype(np.uint32), np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), _BLOCK):
        np.minimum(least, (low[at : at + _BLOCK, None] * factors).min(axis=0), out=least)
    mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed((least.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    texts = batch.column("text")
    for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        yield low, high, [shingle_set(t, width) for t in utf8(texts.slice(low, high - low))]


def _signatures(width: int, bands: int, rows: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets in _sets(batch, width):
                names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                a, b = (pa.array(np.array([x >> 64 * i & (1 << 64) - 1 for x in names], dtype=np.uint64).view(np.int64)) for i in (1, 0))
                fp = pa.array(np.array([of_hashes(s) for s in sets], dtype=np.uint64).view(np.int64))
                keys = pa.array([band_keys(s, bands, rows) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), a, b, fp, keys], names=["doc_id", "a", "b", "fp", "keys"])

    return run


@tidy
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that share a key, as a star forest of the rows that a task holds."""
    for rows in sorted_runs(batches, "key", ["key", "rep"]):
        key, rep = rows["key"], rows["rep"]
        new = np.r_[True, key[1:] != key[:-1]]
        first = rep[np.flatnonzero(new)][np.cumsum(new) - 1]
        other = first != rep
        if other.any():
            x, y = local_forest(rep[other], first[other])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between sets of at least this Jaccard similarity, enough to connect all that such links connect."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(len(codes), dtype=bool)
    held, flat, alive = np.arange(len(sets)), codes, np.ones(len(sets), dtype=bool)
    starts, a, b = ends - sizes, [], []
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], stack = False, [seed]
        while stack:
            x = stack.pop()
            left = alive[held]
            if not left.any():
                return a, b
            if 2 * left.sum() < len(held):
                flat, held = flat[np.repeat(left, sizes[held])], held[left]
                starts = np.cumsum(sizes[held]) - sizes[held]
            own = codes[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            near = held[alive[held] & (common / (sizes[held] + sizes[x] - common) >= similarity)].tolist()
            alive[near] = False
            stack += near
            a += [x] * len(near)
            b += near
    return a, b


def _verified(similarity: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "cell", ["cell", "rep", "shingles"]):
            cell, rep = rows["cell"], rows["rep"]
            bounds = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high - low > 1:
                    x, y = similar([np.frombuffer(s, dtype="<u8") for s in rows["shingles"][low:high]], similarity)
                    a += rep[low:high][x].tolist()
                    b += rep[low:high][y].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 7, bands: int = 30, rows: int = 6, cell_shingles: int = 1 << 21, hot_rows: int = 1024) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: documents whose shingle sets have this Jaccard similarity or more.

    component_id is the smallest doc_id that links reach. No pair below ``similarity`` links. All pairs whose SimHashes
    differ in up to ``radius`` bits are candidates; a pair at s or above is one too, by its minima, but for a chance of
    (1 - s ** rows) ** bands, 1 in 9,000 for the defaults at 0.8, and candidates are compared by their whole sets of
    64-bit hashes. With ``bands`` 0 SimHash alone gives the candidates. Words are split at ASCII white space after A-Z is
    lower-cased; a text of fewer than ``width`` words is one shingle; texts without words, null included, link with
    each other. Rows that repeat a doc_id are one document, and each come back. A row without doc_id comes back
    with a null component_id and takes part in no link. Other columns are ignored; an empty table gives an empty
    result. Equal sets are one row; a candidate group of over ``cell_shingles`` shingles is split into blocks, and
    each two blocks meet in a cell; equal sets of over ``hot_rows`` documents are dealt to several tasks. Only a filter of bounded size reaches the driver.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.where("doc_id is not null")
    signed = scratch.save(named.mapInArrow(_signatures(width, bands, rows), "doc_id long, a long, b long, fp long, keys array<long>"))
    distinct = scratch.save(signed.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    mine, least = spread(signed.select("doc_id", "a", "b"), distinct.where("n > 1").select("a", "b", "rep", "n"), ["a", "b"], ["doc_id"], hot_rows)
    equal = mine.join(least, ["a", "b", "part"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    met = distinct.select("rep", F.explode("keys").alias("key")).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    prints = scratch.save(distinct.groupBy("fp").agg(F.min("rep").alias("rep"), F.count("*").alias("n")))
    owners, first = spread(distinct.select("fp", F.col("rep").alias("a")), prints.where("n > 1"), ["fp"], ["a"], hot_rows)
    alike = owners.join(first, ["fp", "part"]).where("a != rep").select("a", F.col("rep").alias("b"))  # different sets of one SimHash
    close = close_links(prints.select("fp", "rep"), scratch, radius)
    group = scratch.save(connected_components(met.mapInArrow(_met, "a long, b long").union(close).union(alike), scratch))

    # A filter of bounded size says which documents of the second scan may be candidates; a join makes it exact.
    wanted = BitFilter(spark, scratch.save(group.select(F.xxhash64("node").alias("h"))))

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted.maybe(batch.column("h").to_numpy())))
            for low, high, found in _sets(some, width):
                yield pa.RecordBatch.from_arrays([some.column("doc_id").slice(low, high - low), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "size", "shingles"])

    found = named.withColumn("h", F.xxhash64("doc_id")).mapInArrow(sets, "rep long, size long, shingles binary").where("size > 0")
    found = scratch.save(found.join(group.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep"))
    hot = found.groupBy("group").agg(F.sum("size").alias("total")).where(F.col("total") > cell_shingles)
    hot = scratch.save(hot.select("group", (F.ceil(F.col("total") / cell_shingles)).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)
    cells = F.transform(others, lambda j: F.xxhash64("group", F.least(j, mine), F.greatest(j, mine)))
    cells = found.join(small_or_shuffled(hot), "group", "left").select("rep", "shingles", F.explode(F.when(F.col("blocks").isNull(), F.array(F.xxhash64("group"))).otherwise(cells)).alias("cell"))
    cells = cells.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell")
    links = cells.mapInArrow(_verified(similarity), "a long, b long")
    component = connected_components(links.union(equal), scratch)
    return texts.join(component, texts.doc_id == component.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
