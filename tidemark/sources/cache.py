"""Stores of aggregation state: a fingerprint leads to a time and the state of all rows before it."""

from __future__ import annotations

import json
import threading
import uuid
from abc import ABC, abstractmethod
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class State:
    """State rows, either in the driver or in files. ``version`` tells what they mean; another one is a miss.

    ``snapshot`` names the input that the state and the ``tail`` (state of rows that are not to be stored) were made
    of, if that is known. ``n`` is the number of rows in files. ``note`` is what a feeder has to know.
    """

    schema: StructType
    table: pa.Table | None = None
    path: str | None = None
    version: str = ""
    tail: pa.Table | None = None
    snapshot: str | None = None
    n: int = 0
    note: dict | None = None

    @property
    def rows(self) -> int:
        return self.table.num_rows if self.table is not None else self.n

    @property
    def tail_rows(self) -> int:
        return self.tail.num_rows if self.tail is not None else 0

    def like(self, other: State) -> bool:
        """Whether both mean the same, so that the later one is the better one."""
        return (self.version, self.schema) == (other.version, other.schema)

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.table is not None:
            return spark.createDataFrame(self.table if self.table.num_rows else [], schema=self.schema)
        return spark.read.schema(self.schema).parquet(self.path)


class CacheEntry(ABC):
    """What a cache has for a fingerprint at the time of the lookup; later puts do not change it."""

    def __init__(self, put):
        self._put = put

    @abstractmethod
    def occupied(self) -> bool: ...

    def put(self, timestamp: int, state: State) -> None:
        self._put(timestamp, state)


class VacantEntry(CacheEntry):
    def occupied(self) -> bool:
        return False


class OccupiedEntry(CacheEntry):
    def __init__(self, put, timestamp: int, state: State):
        super().__init__(put)
        self._timestamp, self._state = timestamp, state

    def occupied(self) -> bool:
        return True

    def timestamp(self) -> int:
        return self._timestamp

    def get(self) -> State:
        return self._state


class QueryCache(ABC):
    """Implement ``entry``, and ``remove``/``clear`` where state should be dropped. ``durable`` says that entries outlive the driver.

    A put of an older time than the stored one is ignored, if both states mean the same: of two sessions that
    run a query at once, the one with the later clock counts.
    """

    durable = False

    @abstractmethod
    def entry(self, fingerprint: str) -> CacheEntry: ...

    def remove(self, fingerprint: str) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError


class MemoryQueryCache(QueryCache):
    """Entries in the driver, shared by all sessions that hold the object; the least recently used go first."""

    def __init__(self, max_entries: int | None = None):
        self._entries: OrderedDict[str, tuple[int, State]] = OrderedDict()
        self._lock, self._max = threading.Lock(), max_entries

    def entry(self, fingerprint: str) -> CacheEntry:
        put = lambda timestamp, state: self._store(fingerprint, timestamp, state)
        with self._lock:
            found = self._entries.get(fingerprint)
            if found is None:
                return VacantEntry(put)
            self._entries.move_to_end(fingerprint)
            return OccupiedEntry(put, *found)

    def _store(self, fingerprint: str, timestamp: int, state: State) -> None:
        with self._lock:
            old = self._entries.get(fingerprint)
            if old is not None and old[0] > timestamp and old[1].like(state):
                return
            self._entries[fingerprint] = (timestamp, state)
            self._entries.move_to_end(fingerprint)
            while self._max is not None and len(self._entries) > self._max:
                self._entries.popitem(last=False)

    def remove(self, fingerprint: str) -> None:
        with self._lock:
            self._entries.pop(fingerprint, None)

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()

    def __len__(self) -> int:
        return len(self._entries)

    def __repr__(self) -> str:
        return self.display()

    def display(self) -> str:
        out = ["## MemoryQueryCache:"]
        with self._lock:
            for fingerprint, (timestamp, state) in self._entries.items():
                out += [f"### {fingerprint}", f"timestamp: {timestamp} data:"]
                out.append(state.table.to_pandas().to_string(index=False) if state.table is not None else f"files in {state.path}")
        return "\n".join(out)


class ParquetQueryCache(QueryCache):
    """State in a folder of any file system that Spark reaches; sessions and clusters may share it.

    A put writes a new version of the state, then replaces the entry's small metadata file by a rename, so a
    reader sees the old pair of time and state or the new one. Of two writers at once the last one wins, unless
    it sees that the other has stored a later time.
    """

    durable = True

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _meta(self, fingerprint: str) -> str:
        return f"{self.folder}/{fingerprint}/entry.json"

    def _read(self, path: str) -> dict | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entry(self, fingerprint: str) -> CacheEntry:
        put = lambda timestamp, state: self._store(fingerprint, timestamp, state)
        meta = self._read(self._meta(fingerprint))
        if meta is None:
            return VacantEntry(put)
        state = State(StructType.fromJson(meta["schema"]), path=meta["path"], version=meta["version"], n=meta["rows"], snapshot=meta["snapshot"], note=meta["note"])
        return OccupiedEntry(put, meta["timestamp"], state)

    def _store(self, fingerprint: str, timestamp: int, state: State) -> None:
        path = f"{self.folder}/{fingerprint}/state-{uuid.uuid4().hex}"
        state.frame(self.spark).write.parquet(path)
        snapshot = None if state.tail_rows else state.snapshot
        meta = {"timestamp": timestamp, "path": path, "schema": state.schema.jsonValue(), "version": state.version, "rows": state.rows, "snapshot": snapshot, "note": state.note}
        fresh = f"{self._meta(fingerprint)}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(fresh), True)
        try:
            stream.write(json.dumps(meta).encode())
        finally:
            stream.close()
        target, old = self._path(self._meta(fingerprint)), self._read(self._meta(fingerprint))
        if old and old["timestamp"] > timestamp and State(StructType.fromJson(old["schema"]), version=old["version"]).like(state):
            self._fs.delete(self._path(fresh), False)
            self._fs.delete(self._path(path), True)
            return
        if not self._fs.rename(self._path(fresh), target):  # some file systems do not rename over a file
            self._fs.delete(target, False)
            self._fs.rename(self._path(fresh), target)
        if old:
            self._prune(fingerprint, {old["path"], path})

    def _prune(self, fingerprint: str, keep: set[str]) -> None:
        """Deletes versions older than the last one, which a running query may still read."""
        names = {k.rsplit("/", 1)[1] for k in keep}
        for status in self._fs.listStatus(self._path(f"{self.folder}/{fingerprint}")):
            name = status.getPath().getName()
            if name.startswith("state-") and name not in names:
                self._fs.delete(status.getPath(), True)

    def remove(self, fingerprint: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{fingerprint}"), True)

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)
