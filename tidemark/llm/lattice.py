"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random and scaled; each eight projected numbers are decoded to the nearest point of
the E8 lattice, and the points of a table's blocks together name a cell. In several tables every vector has a
home cell and probes the neighbouring lattice cells nearest to it. What meets in the cells at first are signatures
of 128 bits; only the vectors that have a near signature in a cell follow there, and are compared by their exact
cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, expand, local_forest, salted, shuffle_partitions, sorted_runs, tidy
from .components import connected_components

#: Bits of a key that hold the table's number.
_TABLE_BITS = 9
#: The length of a vector for which the scale of the cells is as given.
FULL_DIM = 64
#: Bits of a signature.
SIGNATURE = 128


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of x[..., 8]: the better of D8 and D8 + 1/2."""

    def d8(v):
        point = np.rint(v)
        off = v - point
        odd = point.sum(axis=-1).astype(np.int64) & 1 == 1
        worst = np.abs(off).argmax(axis=-1)[..., None]
        other = point.copy()
        np.put_along_axis(other, worst, np.take_along_axis(point, worst, -1) + np.where(np.take_along_axis(off, worst, -1) >= 0, 1, -1), -1)
        return np.where(odd[..., None], other, point)

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[..., None], a, b)


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@lru_cache
def _projection(dim: int, table: int, blocks: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, table, 77])
    width = 8 * blocks
    basis = np.hstack([np.linalg.qr(rng.normal(size=(dim, min(dim, width))))[0] for _ in range(-(-width // dim))])[:, :width]
    return basis * scale, rng.uniform(size=width)


def plan(n: int) -> tuple[int, int]:
    """(blocks, tables) for n vectors: for each 30-fold over a million a block more, which leaves 1 in 30 chance meetings, and more tables to keep recall."""
    more = max(0, math.ceil(math.log(max(n, 1) / 1e6) / math.log(30)))
    return 2 + more, round(8 * 2.5**more)


def cell_keys(unit: np.ndarray, tables: int, blocks: int, scale: float, probes: int) -> np.ndarray:
    """keys[vector, table, k]: the home cell at k = 0, then the ``probes`` neighbouring cells nearest to the vector.

    ``scale`` is for FULL_DIM numbers. The projected distance of two vectors shrinks as their length grows, so the
    scale follows, and pairs at a cosine meet as often at any length.
    """
    n, dim = unit.shape
    scale *= math.sqrt(dim / FULL_DIM)
    mix = np.random.default_rng(5).integers(1, 1 << 62, 8 * blocks, dtype=np.int64) | 1
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    around = neighbours()
    for t in range(tables):
        basis, offset = _projection(dim, t, blocks, scale)
        y = (unit @ basis + offset).reshape(n, blocks, 8)
        home = decode(y)
        near = ((y - home) @ around.T).reshape(n, blocks * len(around))
        best = np.argpartition(-near, probes, axis=1)[:, :probes]
        cells = np.repeat((2 * home).astype(np.int64)[:, None], 1 + probes, axis=1)
        rows = np.arange(n)[:, None]
        cells[rows, 1 + np.arange(probes)[None, :], best // len(around)] += (2 * around[best % len(around)]).astype(np.int64)
        h = (cells.reshape(n, 1 + probes, -1) * mix).sum(axis=2).view(np.uint64) + np.uint64(dim * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out[:, t] = ((h >> np.uint64(_TABLE_BITS + 1) << np.uint64(_TABLE_BITS)) | np.uint64(t)).view(np.int64)
    return out


def most_differing(cosine: float) -> int:
    """The bits of a signature in which a pair at ``cosine`` may differ: the mean and four deviations, so 1 such pair in 20,000 differs in more."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(SIGNATURE * p + 4 * math.sqrt(SIGNATURE * p * (1 - p)))


@lru_cache
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 91]).normal(size=(dim, SIGNATURE))


def signatures(unit: np.ndarray) -> np.ndarray:
    """The sides of SIGNATURE random planes on which each vector lies, as two 64-bit numbers."""
    return np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1).view(np.int64).reshape(len(unit), -1)


def _packed(x: np.ndarray) -> bytes:
    """A vector as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return b"4" + single.tobytes() if np.array_equal(single.astype("<f8"), x) else b"8" + x.tobytes()


def _by_length(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors in double precision) of the vectors of each length."""
    parsed = [np.frombuffer(v, dtype="<f4" if v[:1] == b"4" else "<f8", offset=1) for v in vectors]
    sizes = np.array([len(x) for x in parsed])
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        v = np.array([parsed[i] for i in some], dtype=np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield some, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; null where a vector links with nothing."""
    for batch in batches:
        column, out = batch.column("embedding"), []
        numbers = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
        bounds = column.offsets.to_numpy().tolist()
        for low, high, null in zip(bounds, bounds[1:], column.is_null().to_pylist(), strict=False):
            x = numbers[low:high]
            out.append(_packed(x) if not null and x.any() and np.isfinite(x).all() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def _keyed(**cells):
    """Adds to each different vector its signature, and its cell keys as bytes: for each table the home, then the probes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                keys, signed = [b""] * batch.num_rows, np.zeros((batch.num_rows, SIGNATURE // 64), dtype=np.int64)
                for some, unit in _by_length(batch.column("vec").to_pylist()):
                    signed[some] = signatures(unit)
                    for i, k in zip(some.tolist(), cell_keys(unit, **cells), strict=True):
                        keys[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(keys, pa.binary())], names=[*batch.schema.names, "s0", "s1", "keys"])

    return run


def _bucket_rows(tables: int, probes: int):
    """A home row and 1 + ``probes`` probe rows for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 8192):
                batch = whole.slice(low, 8192)
                n, ways = batch.num_rows, 1 + probes
                keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), dtype=np.int64).reshape(n, tables, ways)
                side = np.r_[np.zeros(n * tables, dtype=np.int8), np.ones(n * tables * ways, dtype=np.int8)]
                at = np.r_[np.repeat(np.arange(n), tables), np.repeat(np.arange(n), tables * ways)]
                rows = [batch.column(c).to_numpy()[at] for c in ("cls", "s0", "s1")]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys[:, :, 0].ravel(), keys.ravel()]), pa.array(side), *map(pa.array, rows)], names=["key", "side", "cls", "s0", "s1"])

    return run


def _partners(most: int):
    """The rows of each cell that face another vector's row whose signature differs in at most ``most`` bits."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "cell", ["cell", "side", "key", "cls", "s0", "s1"]):
            cell, side, cls = rows["cell"], rows["side"], rows["cls"]
            new = np.r_[True, cell[1:] != cell[:-1]]
            starts, of = np.flatnonzero(new), np.cumsum(new) - 1
            homes = np.add.reduceat((side == 0).astype(np.int64), starts)
            probes, near = np.flatnonzero(side == 1), np.zeros(len(cell), dtype=bool)
            for owner, home in expand(starts[of[probes]], homes[of[probes]], 1 << 19):
                probe = probes[owner]
                differ = sum(np.bitwise_count((rows[s][probe] ^ rows[s][home]).view(np.uint64)).astype(np.int16) for s in ("s0", "s1"))
                close = (differ <= most) & (cls[probe] != cls[home])
                near[probe[close]] = near[home[close]] = True
            some = np.flatnonzero(near)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][some]) for c in ("cell", "side", "key", "cls")], names=["cell", "side", "key", "cls"])

    return run


def _links(cosine: float, tables: int, probes: int):
    """Verified links of each cell. Rows: (a, b, 0) edges of a star forest; (a, null, n) n more links of vector a.

    A pair that meets in several cells counts in the first table, and there with the smaller id probing if both do.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "cell", ["cell", "side", "key", "cls", "n", "vec", "keys"]):
            side, cls = rows["side"], rows["cls"]
            bounds = np.r_[np.flatnonzero(np.r_[True, rows["cell"][1:] != rows["cell"][:-1]]), len(cls)]
            probe, home, units = [], [], []
            length, inside = np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
            for some, u in _by_length(rows["vec"].tolist()):
                length[some], inside[some] = len(units), np.arange(len(some))
                units.append(u)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                mid = low + int((side[low:high] == 0).sum())
                u = units[length[low]]  # vectors of different lengths have different keys
                h = u[inside[low:mid]]
                for a in range(mid, high, 2048):
                    q = u[inside[a : min(high, a + 2048)]]
                    x, y = np.nonzero((q @ h.T >= cosine) & (cls[a : a + len(q)][:, None] != cls[low:mid][None, :]))
                    probe.append(x + a)
                    home.append(y + low)
            probe, home = np.concatenate(probe), np.concatenate(home)
            if not len(probe):
                continue
            keys = np.frombuffer(b"".join(rows["keys"].tolist()), dtype=np.int64).reshape(len(cls), tables, 1 + probes)
            first = _first_meeting(rows, keys, probe, home)
            probe, home = probe[first], home[first]
            ends, others = np.r_[cls[probe], cls[home]], np.r_[rows["n"][home], rows["n"][probe]]
            ids, place = np.unique(ends, return_inverse=True)
            more = np.bincount(place, weights=others, minlength=len(ids)).astype(np.int64)
            a, b = local_forest(cls[probe], cls[home])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a, ids]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(ids), pa.int64())]), pa.array(np.r_[np.zeros(len(a), dtype=np.int64), more])], names=["a", "b", "more"]
            )

    return run


def _first_meeting(rows: dict[str, np.ndarray], keys: np.ndarray, probe: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Which of the meetings (probe row, home row) are the first of their pair. keys: of each row's vector."""
    cls, table = rows["cls"], rows["key"] & ((1 << _TABLE_BITS) - 1)
    out = np.zeros(len(probe), dtype=bool)
    for low in range(0, len(probe), 1 << 16):
        p, h = probe[low : low + (1 << 16)], home[low : low + (1 << 16)]
        swap = cls[p] > cls[h]  # 1: the larger id probes
        small, large = np.where(swap, h, p), np.where(swap, p, h)
        best = np.full(len(p), 1 << 30)
        for t in reversed(range(keys.shape[1])):
            best[(keys[large, t] == keys[small, t, :1]).any(axis=1)] = 2 * t + 1
            best[(keys[small, t] == keys[large, t, :1]).any(axis=1)] = 2 * t
        out[low : low + (1 << 16)] = best == 2 * table[p] + swap
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, scale: float = 3.0, probes: int = 4, blocks: int | None = None, tables: int | None = None, cell_rows: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding).

    Vectors with a cosine of at least ``cosine`` link; no pair below it does, and a pair above it is found unless
    its two vectors meet in none of ``tables`` tables, which happens to fewer than 1 in 100 at a cosine of 0.9, or
    their signatures differ too much, 1 in 20,000. n_links counts the other rows linked directly, equal vectors
    included; component_id is the smallest vec_id that links reach, kept says that it is the row's own. Vectors
    that are null, empty, zero or hold a null or non-finite number have no link, nor do vectors of different
    lengths with each other. Rows that repeat a vec_id count each; a row without vec_id comes back with no links,
    a null component and kept true. Other columns are ignored; an empty table gives an empty result.

    Equal vectors are one row in the cells, whatever their number. A row of a cell is a key, an id and a signature,
    and a vector goes only to the cells in which it has a near signature. Of a pair only its ends' counts and a
    local star forest leave a task; large cells are split into a grid of smaller ones.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.save(rows.mapInArrow(_clean, "vec_id long, vec binary"))
    classes = rows.where("vec is not null and vec_id is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # Classes have numbers of their own, as a repeated vec_id may name two of them.
    classes = scratch.save(classes.select("vec", "rep", "n", F.monotonically_increasing_id().alias("cls")))
    planned = plan(classes.count())
    tables, blocks = tables or planned[1], blocks or planned[0]
    if tables >= 1 << _TABLE_BITS:
        raise ValueError(f"more than {(1 << _TABLE_BITS) - 1} tables")
    keyed = classes.select("cls", "n", "vec").mapInArrow(_keyed(tables=tables, blocks=blocks, scale=scale, probes=probes), "cls long, n long, vec binary, s0 long, s1 long, keys binary")
    keyed = scratch.save(keyed)
    rows_of = keyed.select("cls", "s0", "s1", "keys").mapInArrow(_bucket_rows(tables, probes), "key long, side byte, cls long, s0 long, s1 long")
    meet = salted(rows_of, "key", "side", "cls", cell_rows, scratch).select("cell", "side", "key", "cls", "s0", "s1")
    meet = meet.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "side")
    facing = scratch.save(meet.mapInArrow(_partners(most_differing(cosine)), "cell long, side byte, key long, cls long"))
    meet = facing.join(keyed.select("cls", "n", "vec", "keys"), "cls").repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "side")
    found = scratch.save(meet.mapInArrow(_links(cosine, tables, probes), "a long, b long, more long"))
    scratch.drop(keyed, facing)
    component = connected_components(found.where("b is not null").select("a", "b"), scratch)
    more = found.where("b is null").groupBy("a").agg(F.sum("more").alias("more"))
    summed = classes.join(component, classes.cls == component.node, "left").join(more, classes.cls == more.a, "left")
    summed = summed.select("vec", "rep", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    least = summed.groupBy("component").agg(F.min("rep").alias("component_id"))
    summed = summed.join(least, "component").select("vec", "n_links", "component_id")
    joined = rows.join(summed, "vec", "left")
    zero = F.lit(0).cast("long")
    own = F.col("vec_id").isNotNull()
    return joined.select(
        "vec_id", F.when(own, F.coalesce("n_links", zero)).otherwise(zero).alias("n_links"), F.when(own, F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
