"""A log of caching decisions. A failing log never fails a query."""

from __future__ import annotations

import sys
import threading
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from enum import Enum


class Level(Enum):
    INFO = "info"
    WARN = "warn"


@dataclass
class QueryLog:
    query_fingerprint: str
    messages: list[tuple[Level, str]] = field(default_factory=list)


class AbstractLog(ABC):
    @abstractmethod
    def log(self, level: Level, fingerprint: str, message: str) -> None: ...

    def info(self, fingerprint: str, message: str) -> None:
        self._safe(Level.INFO, fingerprint, message)

    def warn(self, fingerprint: str, message: str) -> None:
        self._safe(Level.WARN, fingerprint, message)

    def history(self) -> list[QueryLog] | None:
        """What was logged, query by query; None if the log keeps nothing."""
        return None

    def _safe(self, level: Level, fingerprint: str, message: str) -> None:
        try:
            self.log(level, fingerprint, message)
        except Exception as e:
            print(f"query cache log failed: {e}", file=sys.__stderr__)


class NoOpLog(AbstractLog):
    def log(self, level: Level, fingerprint: str, message: str) -> None:
        pass


class MemoryLog(AbstractLog):
    def __init__(self):
        self._entries: list[QueryLog] = []
        self._lock = threading.Lock()

    def log(self, level: Level, fingerprint: str, message: str) -> None:
        with self._lock:
            if not self._entries or self._entries[-1].query_fingerprint != fingerprint:
                self._entries.append(QueryLog(fingerprint))
            self._entries[-1].messages.append((level, message))

    def history(self) -> list[QueryLog]:
        with self._lock:
            return [QueryLog(e.query_fingerprint, list(e.messages)) for e in self._entries]


class StderrLog(AbstractLog):
    """Colours for a terminal; a fingerprint is printed when it differs from the last one."""

    _COLOURS = {Level.INFO: 34, Level.WARN: 33}

    def __init__(self, stream=None):
        self.stream, self._last = stream, None

    def log(self, level: Level, fingerprint: str, message: str) -> None:
        out = self.stream or sys.stderr
        if fingerprint != self._last:
            self._last = fingerprint
            print(f"\x1b[32m{fingerprint}\x1b[0m", file=out)
        print(f"  \x1b[{self._COLOURS[level]}m{level.value}: {message}\x1b[0m", file=out)
