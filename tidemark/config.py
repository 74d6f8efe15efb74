"""What the cache may assume about time: which columns order a table, which functions bucket them, what time it is."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from .sources.cache import QueryCache


def micros(value: datetime | int) -> int:
    """Microseconds since the epoch; a naive datetime is taken as UTC."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=UTC)
        return round((value - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)
    return int(value)


@dataclass(frozen=True)
class QueryCacheConfig:
    """``default_temporal_column`` is "table.column"; its table is taken to grow in the order of that column.

    ``allowed_lateness`` (microseconds) keeps the latest rows out of the stored state, so rows that arrive that
    late are still counted. ``immutable_joins`` permits caching over joins whose other sides never change.
    ``driver_rows`` and ``driver_bytes`` bound the state that is kept in the driver; larger state goes to files.

    A column without a zone (dates, timestamps without time zone) is taken to show the time of the session's zone.
    Where that zone puts its clocks back, rows of the repeated hour need an hour of ``allowed_lateness``.
    """

    default_temporal_column: str
    cache: QueryCache
    temporal_columns: frozenset[str] = frozenset()
    group_by_functions: frozenset[str] = frozenset()
    now: int | None = None
    allowed_lateness: int = 0
    immutable_joins: bool = False
    driver_rows: int = 50_000
    driver_bytes: int = 64 << 20

    def __post_init__(self):
        columns = {c.lower() for c in (*self.temporal_columns, self.default_temporal_column)}
        for c in columns:
            if "." not in c:
                raise ValueError(f"a temporal column is named as table.column: {c!r}")
        object.__setattr__(self, "default_temporal_column", self.default_temporal_column.lower())
        object.__setattr__(self, "temporal_columns", frozenset(columns))
        object.__setattr__(self, "group_by_functions", frozenset(f.lower() for f in self.group_by_functions))

    def with_temporal_column(self, column: str) -> QueryCacheConfig:
        return replace(self, temporal_columns=self.temporal_columns | {column})

    def with_override_now(self, now: datetime | int | None) -> QueryCacheConfig:
        return replace(self, now=None if now is None else micros(now))

    def with_group_by_function(self, name: str) -> QueryCacheConfig:
        return replace(self, group_by_functions=self.group_by_functions | {name})

    def allow_group_by_function(self, name: str) -> bool:
        return name.lower() in self.group_by_functions

    def allow_temporal_column(self, column: str) -> bool:
        return column.lower() in self.temporal_columns

    def clock(self) -> int:
        """The time that splits stored rows from rows computed anew, in microseconds."""
        return (time.time_ns() // 1000 if self.now is None else self.now) - self.allowed_lateness
