"""Incremental aggregation for PySpark: aggregate queries over growing tables read only what is new."""

from .config import QueryCacheConfig
from .log import AbstractLog, Level, MemoryLog, NoOpLog, QueryLog, StderrLog
from .operators.maintain import CacheStats
from .session import CachedSession, cached_agg, with_query_cache
from .sources.cache import CacheEntry, MemoryQueryCache, OccupiedEntry, ParquetQueryCache, QueryCache, State, VacantEntry

__all__ = [
    "AbstractLog", "CacheEntry", "CacheStats", "CachedSession", "Level", "MemoryLog", "MemoryQueryCache", "NoOpLog", "OccupiedEntry", "ParquetQueryCache", "QueryCache", "QueryCacheConfig", "QueryLog", "State",
    "StderrLog", "VacantEntry", "cached_agg", "with_query_cache",
]
