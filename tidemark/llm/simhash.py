"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Fingerprints of ``bits`` bits are cut into partitions of correlated bits. For a query the thresholds of the
partitions sum to radius - partitions + 1, so at least one partition of every fingerprint within the radius
differs in no more bits than its threshold. A dynamic programme picks, for each query fingerprint, the
thresholds with the fewest estimated candidates; a partition with a very common value gets -1 (no probe).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, expand, local_forest, salted, shuffle_partitions, slices, sorted_runs, tidy, utf8
from .components import connected_components

BITS = 64
#: Shingles hashed at once, which bounds memory for very long texts.
SHINGLES = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, SHINGLES):
        part = words[low : min(n, low + SHINGLES) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        ones += _ones(np.fromiter((digest(g, seed) for g in grams), dtype="<u8"))
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, given by their 64-bit hashes; zero for the empty set."""
    ones = sum((_ones(hashes[low : low + SHINGLES]) for low in range(0, len(hashes), SHINGLES)), np.zeros(BITS, dtype=np.int64))
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = []
        for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            prints += [fingerprint(t) for t in utf8(texts.slice(low, high - low))]
        out = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; fp holds the 64 bits as a signed number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def correlated_partitions(ones: np.ndarray, both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size; each group takes the bits most correlated with those it has.

    ``ones[i]`` counts fingerprints with bit i, ``both[i, j]`` those with bits i and j, of ``n``.
    """
    p = ones / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    left, groups = list(range(BITS)), []
    for g in range(parts):
        size = BITS // parts + (g < BITS % parts)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.int64)
    fps = fps.view(np.uint64)
    for i, b in enumerate(bits):
        out |= (((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)).view(np.int64)
    return out


def masks(width: int, radius: int) -> list[int]:
    """All ways to flip up to ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds by dynamic programming. costs[q, p, t + 1]: query q's estimated candidates in partition p at threshold t.

    Returns thresholds[q, p] from -1 upwards, which sum to ``total`` and have the smallest summed cost.
    """
    queries, parts, options = costs.shape
    low, high = -parts, total + parts
    width = high - low + 1
    best = np.full((parts + 1, queries, width), np.inf)
    choice = np.zeros((parts, queries, width), dtype=np.int8)
    best[0, :, -low] = 0
    for p in range(parts):
        for t in range(-1, options - 1):
            for s in range(width):
                if 0 <= s - t < width:
                    value = best[p, :, s - t] + costs[:, p, t + 1]
                    better = value < best[p + 1, :, s]
                    best[p + 1, better, s] = value[better]
                    choice[p, better, s] = t
    out = np.zeros((queries, parts), dtype=np.int64)
    state = np.full(queries, total - low)
    for p in reversed(range(parts)):
        out[:, p] = choice[p, np.arange(queries), state]
        state = state - out[:, p]
    return out


def _bucket_rows(groups: list[list[int]], radius: int, counts: list[np.ndarray]):
    """Home rows and probe rows of each fingerprint; counts[p][v]: fingerprints with value v in partition p."""
    total = radius - len(groups) + 1
    options = total + len(groups)  # no threshold is above the radius
    near = []
    for p, bits in enumerate(groups):
        size = len(counts[p])
        kept = np.arange(size)
        rows, sums, added = [np.zeros(size)], np.zeros(size), 0
        for r in range(min(radius, 2) + 1):
            ms = masks(len(bits), r)
            for m in ms[added:]:
                sums = sums + counts[p][kept ^ (m & (size - 1))]
            added = len(ms)
            rows.append(sums + len(ms))
        near.append(np.stack(rows, axis=1).astype(np.float32))
    options = min(options, near[0].shape[1] - 1)
    flips = [{r: np.array(masks(len(bits), r), dtype=np.int64) for r in range(min(radius, 2) + 1)} for bits in groups]

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                fps = batch.column("fp").to_numpy()
                reps = batch.column("rep").to_numpy()
                values = [project(fps, bits) for bits in groups]
                costs = np.stack([near[p][v & (len(near[p]) - 1), : options + 1] for p, v in enumerate(values)], axis=1)
                limits = allocate(costs, total)
                keys, sides, owner = [], [], []
                index = np.arange(len(fps))
                for p, v in enumerate(values):
                    keys.append((v << np.int64(4)) | p)
                    sides.append(np.zeros(len(v), dtype=np.int8))
                    owner.append(index)
                    for r in range(options):
                        who = index[limits[:, p] == r]
                        if len(who):
                            probe = v[who][:, None] ^ flips[p][r][None, :]
                            keys.append(((probe << np.int64(4)) | p).ravel())
                            sides.append(np.ones(probe.size, dtype=np.int8))
                            owner.append(np.repeat(who, probe.shape[1]))
                key, side, own = np.concatenate(keys), np.concatenate(sides), np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fps[own]), pa.array(reps[own])], names=["key", "side", "fp", "rep"])

    return rows


def _linked(radius: int):
    """Verified links of each bucket cell, as a star forest of the rows that a task holds."""

    @tidy
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "cell", ["cell", "side", "fp", "rep"]):
            cell, side, fp, rep = rows["cell"], rows["side"], rows["fp"].view(np.uint64), rows["rep"]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            run = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
            homes = np.add.reduceat((side == 0).astype(np.int64), starts)
            probes = np.flatnonzero(side == 1)
            a, b = [], []
            for owner, home in expand(starts[run[probes]], homes[run[probes]]):
                probe = probes[owner]
                close = (fp[probe] != fp[home]) & (np.bitwise_count(fp[probe] ^ fp[home]) <= radius)
                if close.any():
                    x, y = local_forest(rep[probe[close]], rep[home[close]])
                    a.append(x)
                    b.append(y)
            if a:
                x, y = local_forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return links


def plan(n: int, radius: int) -> int:
    """The number of partitions for n fingerprints: the most that leave at most 16 fingerprints to a value, on average.

    Fewer partitions have more bits each, so a probe meets fewer fingerprints by chance, but probes more values. As
    thresholds go up to 2, a large radius needs more than two.
    """
    parts = radius + 1
    while parts > max(2, -(-(radius + 1) // 3)) and n > 16 << (BITS // parts):
        parts -= 1
    return parts


def near_duplicates(docs: DataFrame, radius: int = 3, parts: int | None = None, bins: int = 1 << 16, cell_rows: int = 8192) -> DataFrame:
    """(doc_id, fingerprint string, component_id): documents whose fingerprints differ in up to ``radius`` bits.

    component_id is the smallest doc_id that links reach. Words are split at ASCII white space after A-Z is
    lower-cased; shingles have three words; a text without words, null included, has the fingerprint zero and
    links like any other. Rows that repeat a doc_id each come back. A row without doc_id comes back with a
    null component_id and takes part in no link. Other columns of ``docs`` are ignored; an empty table gives
    an empty result. ``parts`` None chooses by the number of fingerprints. Only bit counts, pair counts of bits and ``parts`` histograms of ``bins`` numbers reach
    the driver, whatever the input's size.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs))
    distinct = scratch.save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    component = connected_components(close_links(distinct, scratch, radius, parts, bins, cell_rows), scratch)
    classes = distinct.join(component, distinct.rep == component.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def close_links(distinct: DataFrame, scratch: Scratch, radius: int = 3, parts: int | None = None, bins: int = 1 << 16, cell_rows: int = 8192) -> DataFrame:
    """(a, b): links that connect all rows of ``distinct`` whose fingerprints differ in up to ``radius`` bits.

    ``distinct`` is a saved table of different fingerprints, (fp long, rep long); a and b are the rows' ``rep``.
    """
    spark = distinct.sparkSession

    def bit_counts(batches):
        ones, both, n = np.zeros(BITS), np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            ones += bits.sum(axis=0)
            for low in range(0, len(bits), 65536):
                both += bits[low : low + 65536].T @ bits[low : low + 65536]
        values = np.r_[n, ones, both.ravel()].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "n"])

    sums = dict(distinct.select("fp").mapInArrow(bit_counts, "i long, n long").groupBy("i").agg(F.sum("n")).collect())
    stats = np.array([sums.get(i, 0) for i in range(1 + BITS + BITS * BITS)], dtype=np.float64)
    parts = parts or plan(int(stats[0]), radius)
    groups = correlated_partitions(stats[1 : 1 + BITS], stats[1 + BITS :].reshape(BITS, BITS), int(stats[0]), parts)
    bins = [min(bins, 1 << len(g)) for g in groups]

    def histogram(batches):
        seen = [np.zeros(n, dtype=np.int64) for n in bins]
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for p, bits in enumerate(groups):
                seen[p] += np.bincount(project(fps, bits) & (bins[p] - 1), minlength=bins[p])
        for p, counts in enumerate(seen):
            v = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, dtype=np.int32)), pa.array(v), pa.array(counts[v])], names=["p", "v", "n"])

    counted = distinct.select("fp").mapInArrow(histogram, "p int, v long, n long").groupBy("p", "v").agg(F.sum("n").alias("n"))
    counts = [np.zeros(n, dtype=np.float64) for n in bins]
    got = counted.toArrow()
    part, value, number = (got.column(c).to_numpy() for c in ("p", "v", "n"))
    for p in range(parts):
        counts[p][value[part == p]] = number[part == p]

    rows = scratch.save(distinct.select("fp", "rep").mapInArrow(_bucket_rows(groups, radius, counts), "key long, side byte, fp long, rep long"))
    cells = salted(rows, "key", "side", "fp", cell_rows, scratch).select("cell", "side", "fp", "rep")
    cells = cells.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "side")
    return cells.mapInArrow(_linked(radius), "a long, b long")
