"""Helpers that the training-data operators share: tables, scratch space, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, own_folder

#: Text is handed to numpy in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: A table of at most so many rows of a few numbers is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder, which cut lineage and survive the loss of executors.

    A table is deleted when ``drop`` says that nothing reads it any more, the others when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, own_folder(spark, "scratch"), 0

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def save(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """``df`` written and read again; ``path`` adds it to a table that is there."""
        at = path or self.path()
        df.write.mode("append").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._scratch_path)


def release_memory() -> None:
    """Gives memory that this worker has freed back to the system; a reused worker would hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """Releases memory at the end of a task that runs over batches."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int):
    """While it is open, jobs hand Python workers batches of about ``most`` bytes, and the session's own bound holds again after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes objects; null gives b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def expand(first: np.ndarray, counts: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row i the integers first[i] .. first[i] + counts[i] - 1, as (row, integer) arrays of about ``most``."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, most):
        high = min(total, low + most)
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
        rows = np.arange(a, b + 1)
        begin = np.maximum(ends[rows] - counts[rows], low)
        n = np.minimum(ends[rows], high) - begin
        owner = np.repeat(rows, n)
        inner = np.arange(low, high) - np.repeat(ends[rows] - counts[rows], n)
        yield owner, first[owner] + inner


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as a star forest: (node, smallest reachable node) for every node that is not its own root."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a partition sorted by ``key``, as numpy columns in which no run of a key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and last == 0 and held[-1].column(key)[held[-1].num_rows - 1].as_py() == keys[0]:
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, last)] if last else held
        if last == 0 and not held:
            held = [batch]
            continue
        if whole:
            t = pa.Table.from_batches(whole)
            yield {n: t.column(n).to_numpy() for n in names}
        held = [batch.slice(last)]
    if held:
        t = pa.Table.from_batches(held)
        yield {n: t.column(n).to_numpy() for n in names}


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """``df``, a saved table of a few numbers a row, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def salted(rows: DataFrame, key: str, side: str, ident: str, most: int, scratch: Scratch) -> DataFrame:
    """Splits the hot groups of a probe/home bucket table into a grid of cells.

    ``side`` is 0 for home rows and 1 for probe rows. A group of n rows gets a grid of s x s cells,
    s = ceil(n / most): home rows of column block j go to every cell (i, j), probe rows of row block i to
    every cell (i, j), so each home still meets each probe exactly once. Adds column ``cell``, a hash of
    key and cell number; groups up to ``most`` rows keep one cell. ``rows`` is read twice.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("n__")).where(F.col("n__") > most)
    hot = scratch.save(hot.select(key, F.ceil(F.col("n__") / most).cast("int").alias("s__")))
    s = F.coalesce("s__", F.lit(1))
    mine = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), s.cast("long")).cast("int")
    every = F.sequence(F.lit(0), s - 1)
    cells = F.when(F.col(side) == 0, F.transform(every, lambda i: i * s + mine)).otherwise(F.transform(every, lambda j: mine * s + j))
    out = rows.join(small_or_shuffled(hot), key, "left").withColumn("cell__", F.explode(cells))
    return out.withColumn("cell", F.when(s == 1, F.col(key)).otherwise(F.xxhash64(key, "cell__"))).drop("s__", "cell__")


def spread(rows: DataFrame, table: DataFrame, keys: list[str], ident: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``keys`` with a column ``part``, to be joined by too, so that no task gets a hot key alone.

    ``table`` is saved and has each key once, with its number of rows ``n`` in ``rows``. A key of over ``hot_rows`` rows, or
    a ten-thousandth of all, has several parts, to which its rows go by ``ident``.
    """
    total, most = table.agg(F.sum("n"), F.max("n")).first()
    limit = max(hot_rows, (total or 0) // 10_000)
    if (most or 0) <= limit:
        return rows.withColumn("part", F.lit(0)), table.withColumn("part", F.lit(0))
    hot = F.broadcast(table.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("parts__")))  # 10,000 rows at most
    mine = F.pmod(F.xxhash64(*ident), F.col("parts__").cast("long")).cast("int")
    rows = rows.join(hot, keys, "left").withColumn("part", F.coalesce(mine, F.lit(0))).drop("parts__")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("parts__"), F.lit(1)) - 1)
    return rows, table.join(hot, keys, "left").withColumn("part", F.explode(parts)).drop("parts__")


class BitFilter:
    """Tells which 64-bit hashes are not in a set. It has 64 bits, or more, for each of up to 4 million; above that it
    stays at 32 MB and lets more through."""

    LEAST_BITS, MOST_BITS = 20, 28

    def __init__(self, spark: SparkSession, hashes: DataFrame):
        """``hashes``: a saved table whose only column, ``h``, holds evenly spread numbers."""
        self.bits = min(max((64 * hashes.count()).bit_length(), self.LEAST_BITS), self.MOST_BITS)
        low, high = (F.shiftrightunsigned("h", n).bitwiseAND((1 << self.bits) - 1) for n in (0, 64 - self.MOST_BITS))
        words = hashes.select(F.explode(F.array(low, high)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        field = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        field[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        self.field = spark.sparkContext.broadcast(field)  # 2 ** MOST_BITS / 8 bytes at most

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        h, field, last = hashes.view(np.uint64), self.field.value, np.uint64((1 << self.bits) - 1)
        bit = lambda at: (field[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return bit(h & last) & bit((h >> np.uint64(64 - self.MOST_BITS)) & last) == 1
