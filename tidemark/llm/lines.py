"""Line deduplication by a deletion-neighbourhood join.

Two lines are within one edit (insert, delete or change a byte) exactly if deleting one byte from the one or
the other, or from both at the same place, makes them equal. Lines that could have such a partner are found
first: one edit leaves the first or the last half of a line as it was, so only lines that share a half with
another line emit all their one-byte deletions as hashed keys. Lines with equal keys are joined, their edit
distance is verified, and of all that are close the earliest is kept. For a bound of k edits, lines share one of
k + 1 pieces, and emit all deletions of up to k bytes.
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

from .common import BitFilter, Scratch, shuffle_partitions, slices, sorted_runs, spread, tidy, utf8

#: Shorter lines are removed only if they are equal to an earlier one, unless another length is asked for.
LEAST_BYTES = 24
#: A line of more occurrences is dealt to several tasks.
HOT_LINES = 2048
#: Keys of a line that are held at once.
_KEYS = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_LATEST = (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _names(line: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(line)
    return _signed(d >> 64), _signed(d & _MASK)


def is_blank(line: bytes) -> bool:
    return not line or line.isspace()


def within_one_edit(a: bytes, b: bytes) -> bool:
    """Whether the edit distance of two byte strings is 0 or 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    low, high = 0, n
    while low < high:  # length of the common prefix
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def half_keys(line: bytes) -> list[int]:
    """Keys of the halves: lines within one edit share one. m is the length of the shorter line of a pair."""
    n, out = len(line), []
    for m in (n - 1, n):
        p = m // 2
        out.append(_signed(xxhash.xxh3_64_intdigest(line[:p], 2 * m)))
        out.append(_signed(xxhash.xxh3_64_intdigest(line[n - p :], 2 * m + 1)))
    return out


def within_edits(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance of two byte strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    if most == 1:
        return within_one_edit(a, b)
    if a == b:
        return True
    if not most:
        return False
    n, low, high = min(len(a), len(b)), 0, min(len(a), len(b))
    while low < high:  # length of the common prefix
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    if low == n:
        return True  # the rest is no longer than the bound
    a, b = a[low:], b[low:]
    return within_edits(a[1:], b[1:], most - 1) or within_edits(a[1:], b, most - 1) or within_edits(a, b[1:], most - 1)


def piece_keys(line: bytes, edits: int) -> list[int]:
    """Keys of pieces: lines within ``edits`` share one. Of k + 1 pieces of the shorter line the edits leave one as it was, moved by k bytes at most."""
    n, out = len(line), set()
    for m in range(max(0, n - edits), n + 1):  # length of the shorter line of a pair
        for j in range(edits + 1):
            low, high = j * m // (edits + 1), (j + 1) * m // (edits + 1)
            for at in range(-edits, edits + 1):
                if 0 <= low + at and high + at <= n:
                    out.add(_signed(xxhash.xxh3_64_intdigest(line[low + at : high + at], m * (edits + 1) + j)))
    return sorted(out)


def _coded(data: np.ndarray) -> np.ndarray:
    values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _powers(first: int, n: int) -> np.ndarray:
    out = np.full(n, _BASE | 1, dtype=np.uint64)
    out[:1] = pow(_BASE | 1, first, 1 << 64)
    return np.cumprod(out)


def _closed(keys: np.ndarray, length: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return (keys + np.uint64(length * 0x94D049BB133111EB & _MASK)).view(np.int64)


def deletion_key_parts(line: bytes) -> Iterator[np.ndarray]:
    """deletion_keys in parts, so that a very long line needs little memory."""
    n, data = len(line), np.frombuffer(line, dtype=np.uint8)
    parts = [(low, min(n, low + _KEYS)) for low in range(0, n, _KEYS)]
    total = np.uint64(0)  # of all bytes but the first, each moved one place to the front
    with np.errstate(over="ignore"):
        for low, high in parts:
            rest = data[max(low, 1) : high]
            total += (_coded(rest) * _powers(max(low, 1) - 1, len(rest))).sum(dtype=np.uint64)
        before = moved = np.uint64(0)
        for low, high in parts:
            values = _coded(data[low:high])
            held = np.cumsum(values * _powers(low, high - low), dtype=np.uint64)
            # The first byte of all has no place to move to.
            shifted = np.r_[np.zeros(int(low == 0), dtype=np.uint64), values[int(low == 0) :] * _powers(max(low, 1) - 1, high - max(low, 1))]
            gone = moved + np.cumsum(shifted, dtype=np.uint64)
            yield _closed(before + np.r_[np.uint64(0), held[:-1]] + (total - gone), n - 1)
            before, moved = before + held[-1], gone[-1]
    yield _closed(np.array([before], dtype=np.uint64), n)


def deletion_keys(line: bytes) -> np.ndarray:
    """A hash of the line less byte i, for every i, and last a hash of the whole line."""
    return np.concatenate(list(deletion_key_parts(line)))


def all_deletion_keys(line: bytes, edits: int) -> Iterator[list[int]]:
    """Hashes of the different strings that deleting up to ``edits`` bytes leaves, in parts."""
    n, seen, out = len(line), set(), []
    for k in range(min(edits, n) + 1):
        for gone in combinations(range(n), k):
            cuts = (-1, *gone, n)
            key = _signed(xxhash.xxh3_64_intdigest(b"".join([line[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)])))
            if key not in seen:
                seen.add(key)
                out.append(key)
                if len(out) == _KEYS:
                    yield out
                    out = []
    yield out


def _text_lines(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    texts = batch.column("text")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for low, high in slices(sizes):
        yield low, high, [t.split(b"\n") for t in utf8(texts.slice(low, high - low))]


@tidy
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that is not blank: where it is, its 128-bit name, and its length."""
    for batch in batches:
        for low, high, texts in _text_lines(batch):
            rows = [(low + d, i, *_names(line), len(line)) for d, lines in enumerate(texts) for i, line in enumerate(lines) if not is_blank(line)]
            if rows:
                d, i, a, b, n = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("place").take(pa.array(d)), batch.column("row").take(pa.array(d)), pa.array(i), pa.array(a), pa.array(b), pa.array(n)], names=["place", "row", "line", "a", "b", "size"])


def _candidates(texts: list[list[bytes]], least_bytes: int) -> list[bytes]:
    """The different lines of a slice that may be near another."""
    return list({line for lines in texts for line in lines if len(line) >= least_bytes and not is_blank(line)})


def _shares(least_bytes: int, edits: int):
    """Keys of the halves or pieces of every different line of each slice."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _text_lines(batch):
                rows = [(k, *_names(line)) for line in _candidates(texts, least_bytes) for k in (half_keys(line) if edits == 1 else piece_keys(line, edits))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "a", "b"])

    return run


@tidy
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cut, a): the line ``a`` without byte ``cut``; cut -1 is the whole line."""
    held, size = [], 0
    for batch in batches:
        for line, a in zip(utf8(batch.column("line")), batch.column("a").to_pylist(), strict=True):
            at = 0
            for keys in deletion_key_parts(line):
                cut = np.arange(at, at + len(keys), dtype=np.int64)
                at += len(keys)
                cut[cut == len(line)] = -1
                held.append((keys, cut, np.full(len(keys), a)))
                size += len(keys)
                if size >= _KEYS:
                    yield _rows(held)
                    held, size = [], 0
    if held:
        yield _rows(held)


def _rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["key", "cut", "a"])


def _all_variants(edits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, a in zip(utf8(batch.column("line")), batch.column("a").to_pylist(), strict=True):
                for keys in all_deletion_keys(line, edits):
                    if keys:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([a] * len(keys), pa.int64())], names=["key", "a"])

    return run


def _near_groups(edits: int):
    """The lines of each group of equal variants that have an earlier line within ``edits``. A task holds one group at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "key", ["key", "place", "number", "a", "b", "line"]):
            new = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1], True])
            late = []
            for low, high in zip(new[:-1], new[1:], strict=True):
                order = low + np.lexsort((rows["number"][low:high], rows["place"][low:high]))
                lines, places = rows["line"][order].tolist(), list(zip(rows["place"][order].tolist(), rows["number"][order].tolist(), strict=True))
                late += [order[i] for i in range(1, len(order)) if any(places[j] < places[i] and within_edits(lines[i], lines[j], edits) for j in range(i))]
            if late:
                yield pa.RecordBatch.from_arrays([pa.array(rows["a"][late]), pa.array(rows["b"][late])], names=["a", "b"])

    return run


@tidy
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of groups in which all lines are within one edit of each other, or of the group's whole line.

    A group of equal keys has at most 256 lines for each place of a byte, as its lines are distinct and one
    insertion away from the same string.
    """
    for rows in sorted_runs(batches, "key", ["key", "cut", "a"]):
        key, cut, a = rows["key"], rows["cut"], rows["a"]
        order = np.lexsort((a, cut, key))
        key, cut, a = key[order], cut[order], a[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(key)])
        same = np.repeat(sizes, sizes) > 1
        group = np.repeat(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]))
        whole = np.zeros(len(key), dtype=bool)
        whole[group[cut == -1]] = True  # at the group's first row
        inserted = whole[group]
        several = np.bincount(group, minlength=len(key))[group] > 1
        out = [(key[same], cut[same], a[same]), (key[inserted & several], np.where(cut[inserted & several] == -1, -1, -2), a[inserted & several])]
        for k, c, x in out:
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(x)], names=["key", "cut", "a"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within_one_edit(x, y) for x, y in zip(utf8(batch.column("line")), utf8(batch.column("other")), strict=True)]
        kept = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def near_lines(rows: DataFrame, first: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES, edits: int = 1) -> DataFrame:
    """(a, b): names of the lines that have an earlier line within ``edits``. ``first`` has each line's first place."""
    spark = rows.sparkSession
    keys = scratch.save(rows.mapInArrow(_shares(least_bytes, edits), "key long, a long, b long"))
    shared = keys.groupBy("key").agg(F.min(F.struct("a", "b")).alias("x"), F.max(F.struct("a", "b")).alias("y")).where("x != y").select("key")
    candidates = scratch.save(keys.join(shared, "key", "left_semi").select("a", "b").distinct())
    scratch.drop(keys)
    # A filter of bounded size says which lines of the second scan may be candidates; a join makes it exact.
    wanted = BitFilter(spark, candidates.select(F.col("a").alias("h")))

    @tidy
    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _text_lines(batch):
                lines = _candidates(texts, least_bytes)
                if not lines:
                    continue
                names = np.array([_names(x) for x in lines], dtype=np.int64)
                some = np.flatnonzero(wanted.maybe(names[:, 0].copy()))
                yield pa.RecordBatch.from_arrays([pa.array(names[some, 0]), pa.array(names[some, 1]), pa.array([lines[i] for i in some], pa.binary())], names=["a", "b", "line"])

    texts = rows.mapInArrow(maybe, "a long, b long, line binary").join(candidates, ["a", "b"], "left_semi")
    texts = texts.groupBy("a", "b").agg(F.min("line").alias("line")).join(first.select("a", "b", "pos"), ["a", "b"])
    texts = scratch.save(texts)
    if edits > 1:
        variants = scratch.save(texts.select("a", "line").mapInArrow(_all_variants(edits), "key long, a long").distinct())
        several = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        members = variants.join(several, "key", "left_semi").join(texts.select("a", "b", "line", F.col("pos.place").alias("place"), F.col("pos.line").alias("number")), "a")
        members = members.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
        return members.mapInArrow(_near_groups(edits), "a long, b long").distinct()
    variants = texts.select("a", "line").mapInArrow(_variants, "key long, cut long, a long")
    variants = variants.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    members = scratch.save(variants.mapInArrow(_classes, "key long, cut long, a long").distinct())
    placed = members.join(texts, "a")
    # Lines cut at the same place are close to each other; a whole line (-1) is close to all lines cut to it (-2).
    mine = F.struct("pos", "line")
    best = placed.groupBy("key", "cut").agg(F.min(mine).alias("best"))
    facing = best.select("key", F.when(F.col("cut") == -1, -2).when(F.col("cut") == -2, -1).otherwise(F.col("cut")).alias("cut"), "best")
    pairs = placed.join(facing, ["key", "cut"]).where(F.col("best.pos") < F.col("pos"))
    pairs = pairs.select("a", "b", "line", F.col("best.line").alias("other")).distinct()
    return pairs.mapInArrow(_verified, "a long, b long").distinct()


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without the lines whose numbers are gone; null where none are."""
    out = []
    for t, numbers in zip(utf8(text), gone, strict=True):
        if not numbers.is_valid:
            out.append(None)
            continue
        drop = set(numbers.values.to_pylist())
        out.append(b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in drop]).decode())
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, edits: int = 1, keep: tuple[str, ...] = ("doc_id",), least_bytes: int = LEAST_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with kept_text, n_lines and n_removed.

    Lines end at \\n. A line is removed if an earlier line, by (doc_id, line number), is equal or, for lines of
    ``least_bytes`` bytes or more, within ``edits`` edits of its UTF-8 bytes (0: equal lines only); lines are judged
    on the input, whether the earlier one is kept or not. Blank lines are always kept. Lines at the same place, in
    rows that repeat a doc_id, do not count as earlier than each other; a null doc_id comes after all others. A null
    text has no lines and stays null; a text that loses all its lines becomes empty. Names of lines are 128-bit
    hashes. An empty table gives an empty result. If ``docs`` has columns named like the new ones, leave them
    out of ``keep``. A line that occurs often is dealt to several tasks. A line of n bytes that may be near another
    emits n keys for one edit, and about n ** k / k! for k edits.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    place, row = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LATEST)), F.xxhash64(text, F.lit(1))
    rows = docs.select(place.alias("place"), row.alias("row"), text.alias("text"))
    places = scratch.save(rows.mapInArrow(_places, "place long, row long, line long, a long, b long, size long"))
    pos = F.struct("place", "line")
    first = scratch.save(places.groupBy("a", "b").agg(F.min(pos).alias("pos"), F.count("*").alias("n")))
    if edits:
        late = near_lines(rows, first, scratch, least_bytes, edits).withColumn("late", F.lit(True))
        marked = first.join(late, ["a", "b"], "left")
    else:
        marked = first.withColumn("late", F.lit(None).cast("boolean"))
    marked = scratch.save(marked.where("n > 1 or late"))
    dealt, marked = spread(places, marked, ["a", "b"], ["place", "row", "line"], hot_lines)
    judged = dealt.join(marked, ["a", "b", "part"]).where(F.col("late").isNotNull() | (pos > F.col("pos")))
    gone = judged.groupBy("place", "row").agg(F.collect_set("line").alias("gone__"))
    whole = docs.select(*keep, place.alias("place__"), row.alias("row__"), text.alias("text__"))
    joined = whole.join(gone.select(F.col("place").alias("place__"), F.col("row").alias("row__"), "gone__"), ["place__", "row__"], "left")
    touched = F.col("gone__").isNotNull()
    # Called non-deterministic, as Spark would else run it once for each use, and a task would hold a worker for each.
    kept = F.arrow_udf(_without, "string").asNondeterministic()(F.when(touched, F.col("text__")), F.col("gone__"))
    return joined.select(
        *keep, F.coalesce(kept, F.col("text__")).alias("kept_text"), F.coalesce(F.size(F.split("text__", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone__"), F.lit(0)).cast("long").alias("n_removed"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for every row of ``docs``."""
    got = dedup_lines(docs)
    n_lines = F.when(F.col("kept_text").isNull(), 0).otherwise(F.col("n_lines"))
    return got.select("doc_id", n_lines.cast("long").alias("n_lines"), "n_removed", F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: its levenshtein() counts bytes. One edit leaves the first or last half of the shorter line's characters.
ORACLE = """
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM rows WHERE text IS NOT NULL
), full_lines AS (SELECT * FROM lines WHERE trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
first AS (SELECT l, min((doc_id, i)) AS pos FROM full_lines GROUP BY l),
keyed AS (
  SELECT l, pos, m, k, CASE k WHEN 0 THEN left(l, m // 2) ELSE right(l, m // 2) END AS half
  FROM (SELECT l, pos, unnest([len(l), len(l) - 1]) AS m FROM first WHERE strlen(l) >= 24), (VALUES (0), (1)) AS t(k)
), late AS (
  SELECT DISTINCT x.l FROM keyed x JOIN keyed y ON x.m = y.m AND x.k = y.k AND x.half = y.half AND y.pos < x.pos
  WHERE levenshtein(x.l, y.l) <= 1
), judged AS (
  SELECT rid, i, x.l, ((x.doc_id, i) > f.pos) OR x.l IN (SELECT l FROM late) AS gone FROM full_lines x JOIN first f ON x.l = f.l
), everything AS (
  SELECT x.rid, x.i, x.l, coalesce(j.gone, false) AS gone FROM lines x LEFT JOIN judged j ON x.rid = j.rid AND x.i = j.i
), summed AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM everything GROUP BY rid
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM rows LEFT JOIN summed USING (rid)
"""
