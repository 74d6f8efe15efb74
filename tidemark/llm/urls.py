"""URL filters: all glob rules run at once in one bit-parallel Shift-And automaton.

A rule (host, path prefix) becomes a glob over the canonical URL, which is the lower-cased host followed by the
path. Every glob position is one bit of a row of 64-bit words; for each input byte the whole row is shifted and
masked, for a block of URLs together, so the work for a byte does not depend on how many rules fit it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: The rules of the registered query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Automaton:
    """step[byte]: positions that the byte enters; stay[byte]: positions that it keeps, by a ``*`` before the next one."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: list[tuple[int, int]]
    words: int


def compile_globs(globs: list[bytes]) -> Automaton:
    """``*`` stands for any bytes but ``/``, ``**`` for any bytes; all other bytes are literal; a glob fits a whole text."""
    parsed, n = [], 0
    for glob in globs:
        literal: list[int] = []
        stars: dict[int, int] = {}  # literal bytes before the star -> 1 or 2
        i = 0
        while i < len(glob):
            if glob[i] == 42:
                kind = 2 if glob[i : i + 2] == b"**" else 1
                stars[len(literal)] = max(kind, stars.get(len(literal), 0))
                i += kind
            else:
                literal.append(glob[i])
                i += 1
        parsed.append((n, literal, stars))
        n += len(literal) + 1  # a state for each number of literal bytes read
    words = max(1, -(-n // 64))
    step, stay = np.zeros((256, words), dtype=np.uint64), np.zeros((256, words), dtype=np.uint64)
    start, final = np.zeros(words, dtype=np.uint64), []
    for base, literal, stars in parsed:
        start[base // 64] |= np.uint64(1 << base % 64)
        for k, byte in enumerate(literal):
            step[byte, (base + k + 1) // 64] |= np.uint64(1 << (base + k + 1) % 64)
        for k, kind in stars.items():
            stay[:, (base + k) // 64] |= np.uint64(1 << (base + k) % 64)
            if kind == 1:
                stay[47, (base + k) // 64] &= ~np.uint64(1 << (base + k) % 64)
        end = base + len(literal)
        final.append((end // 64, end % 64))
    return Automaton(step, stay, start, final, words)


def fits(automaton: Automaton, texts: list[bytes]) -> np.ndarray:
    """fits[text, glob], for all texts and globs together."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = (np.cumsum(sizes) - sizes)[order]
    state = np.tile(automaton.start, (len(texts), 1))
    alive = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    one, top = np.uint64(1), np.uint64(63)
    for k, n in enumerate(alive):
        byte = data[begin[:n] + k]
        now = state[:n]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        state[:n] = (moved & automaton.step[byte]) | (now & automaton.stay[byte])
    out = np.zeros((len(texts), len(automaton.final)), dtype=bool)
    for g, (word, bit) in enumerate(automaton.final):
        out[order, g] = (state[:, word] >> np.uint64(bit)) & one != 0
    return out


def canonical(url: bytes) -> tuple[bytes, bytes]:
    """(host, path): the host is lower-cased, the path ends at ``?`` or ``#``; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.split(b"?", 1)[0].split(b"#", 1)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_LOWER), slash + path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path; of several the longest
    (host and path) wins, then the first in the list. Without a fitting rule, rule is null and verdict is
    ``default``. A null URL, or one without ``://``, has an empty host and path. Repeated rows are judged one by
    one, other columns are ignored, and an empty table gives an empty result.
    """
    star = b"**"
    globs = [g for _, host, path in rules for g in (host.encode() + path.encode() + star, b"*." + host.encode() + path.encode() + star)]
    automaton = compile_globs(globs)
    names = [host + path for _, host, path in rules]
    rank = sorted(range(len(rules)), key=lambda i: (-len(names[i].encode()), i))
    verdicts = [v for v, _, _ in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = utf8(batch.column("url"))
            for low, high in slices([len(u) for u in urls]):
                parts = [canonical(u) for u in urls[low:high]]
                fit = fits(automaton, [h + p for h, p in parts])
                fit = fit[:, ::2] | fit[:, 1::2]
                best = np.full(high - low, -1)
                for r in reversed(rank):
                    best[fit[:, r]] = r
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(low, high - low), pa.array([h.decode() for h, _ in parts]), pa.array([p.decode() for _, p in parts]), pa.array([names[b] if b >= 0 else None for b in best], pa.string()), pa.array([verdicts[b] if b >= 0 else default for b in best])],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
