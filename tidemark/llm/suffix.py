"""Exact substring deduplication with suffix arrays built by linear grouping.

Every 50-byte window belongs to the smallest hash among its 20-byte parts, its anchor. Windows that follow each
other and share an anchor form one short string, so equal windows of different documents meet under one anchor.
Anchors that only one text has are dropped; under each other anchor a suffix array of the different strings puts
equal windows side by side, and the smallest document of each class of windows keeps them. Where many strings share an
anchor, they are cut again by longer parts, second anchors, and those under a second anchor are ordered together.

The suffix array is built in two phases. Suffixes are grouped by their longest Lyndon prefix: groups are taken in
descending order, each member's previous-smaller pointer is found by walking pointers of higher groups, and the
suffixes pointed to are moved up behind their group, by how many pointers reach them. Then the order is emitted
from the smallest suffix on, each placed suffix placing the chain of pointers before it. No name is ever given to
a group but its place, and nothing is sorted again. Many short texts go through each step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, slices, tidy, utf8

LENGTH, PART = 50, 20
MOST_WINDOWS = LENGTH - PART + 1
#: Texts longer than this are ordered one by one.
TOGETHER = 1024
#: Strings under an anchor of more texts than this are dealt by second anchors of so many bytes.
HOT_TEXTS, HOT_PART = 1 << 15, 35
#: Different strings under an anchor that have more symbols than this are ordered under second anchors of so many bytes.
LARGE, LARGE_PART = 128, 45
#: Texts are cut in slices of about so many bytes; what they give is dealt to the buckets once for so many bytes of text.
CUT_BYTES, DEALT_BYTES = 2 << 20, 1 << 24
#: Text for each bucket, if there are more buckets than partitions.
BUCKET_BYTES = 1 << 24
#: A row that is dealt holds so many anchors or strings at most; the JVM is slow to free large ones.
ROW_ANCHORS, ROW_STRINGS = 1 << 12, 1 << 9
#: Strings are judged in parts of about so many bytes, or one bucket.
JUDGED_BYTES = 1 << 26

_LATEST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


# -- suffix arrays ---------------------------------------------------------------------------------------------------


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] numbers), for all i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def group_suffixes(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 for many texts. symbols[text, i] >= 0 for i < sizes[text]; the last symbol counts as the smallest.

    Returns (group, before), both [text, 1 + i]: the place of the suffix's group in the order, and the pointer to
    the previous smaller suffix, 0 for none. Each text's suffixes stand in ``order`` group by group, so a step looks
    at the members of one group and at the suffixes that they move, and at nothing else.
    """
    texts, n = symbols.shape
    width, cols, every = n + 1, np.arange(n), np.arange(texts)
    base = every * width
    key = np.where(cols < sizes[:, None], symbols.astype(np.int32), np.int32(1 << 20))
    key[every, sizes - 1] = -1
    by_key = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, by_key, axis=1)
    first = np.where(np.c_[np.ones(texts, dtype=bool), ranked[:, 1:] != ranked[:, :-1]], cols, 0)
    start = np.maximum.accumulate(first, axis=1) + base[:, None]
    # Flat numbers from here on: of suffixes base + 1 + i, of groups and places base + place. A text's own base stands for none.
    order, where = np.empty(texts * width, dtype=np.int64), np.empty(texts * width, dtype=np.int64)
    group, size = np.full(texts * width, -1, dtype=np.int64), np.zeros(texts * width, dtype=np.int64)
    suffixes, places = (by_key + base[:, None] + 1).ravel(), (cols + base[:, None]).ravel()
    order[places], where[suffixes], group[suffixes] = suffixes, places, start.ravel()
    inside = (cols < sizes[:, None]).ravel()
    size[: texts * width] = np.bincount(start.ravel()[inside], minlength=texts * width)
    before, moved = np.zeros(texts * width, dtype=np.int64), np.zeros(texts * width, dtype=bool)
    live, high = base, base + sizes  # what is left of each text, and the end of its highest group to come
    while len(live):
        now = group[order[high - 1]]
        at = np.sort(order[_ragged(now, high - now)])
        going = now > live
        live, high = live[going], now[going]
        mine = group[at]
        j = at - 1
        above = np.flatnonzero(group[j] > mine)
        while len(above):
            j[above] = before[j[above]]
            above = above[group[j[above]] > mine[above]]
        before[at] = j
        same = np.flatnonzero(group[j] == mine)
        while len(same):
            j[same] = before[j[same]]
            before[at[same]] = j[same]
            same = same[group[j[same]] == mine[same]]
        to = j[group[j] >= 0]  # ascending, as pointers of one group never cross
        if not len(to):
            continue
        begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        count, to = np.diff(np.r_[begin, len(to)]), to[begin]
        old = group[to]  # the group that each leaves
        by = np.lexsort((count, old))
        to, old, count = to[by], old[by], count[by]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_class = new_old | np.r_[True, count[1:] != count[:-1]]
        old_at, class_at = np.flatnonzero(new_old), np.flatnonzero(new_class)
        leaving, members = np.diff(np.r_[old_at, len(to)]), np.diff(np.r_[class_at, len(to)])
        shift = np.repeat(old[old_at] + size[old[old_at]] - (old_at + leaving), leaving)  # from numbers in ``to`` to places
        target, name = np.arange(len(to)) + shift, np.repeat(class_at, members) + shift
        # They change places with the others at the end of their old group.
        moved[to] = True
        others, free = order[target], where[to]
        others, free = others[~moved[others]], free[free < np.repeat(target[old_at], leaving)]
        moved[to] = False
        order[free], where[others] = others, free
        order[target], where[to] = to, target
        size[old[old_at]] -= leaving
        size[name[class_at]] = members
        group[to] = name
    group = group.reshape(texts, width) - base[:, None]
    group[:, 0] = -1
    group[:, 1:][cols >= sizes[:, None]] = -2
    return group, before.reshape(texts, width)


def emit_order(group: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phase 2 for many texts: order[text, k] is the place (from 0) of the k-th smallest suffix; -1 beyond the text."""
    texts, width = group.shape
    base = np.arange(texts) * width
    flat_group, before = group.ravel().astype(np.int64), before.ravel()
    order = np.full(texts * width, -1, dtype=np.int64)
    slot = np.arange(texts * width)  # the next free place of each group
    open_ = flat_group >= 0
    last = base + sizes
    order[base] = last
    slot[base] += 1
    open_[last] = False
    row_base = np.arange(texts * width) // width * width
    for i in range(int(sizes.max(initial=0))):
        j = order[base[sizes > i] + i] - 1
        j = j[open_[j]]
        while len(j):
            at = row_base[j] + flat_group[j]
            order[slot[at]] = j
            slot[at] += 1
            open_[j] = False
            j = before[j]
            j = j[open_[j]]
    out = order.reshape(texts, width)[:, : width - 1]
    return np.where(out >= 0, out - base[:, None] - 1, -1)


def order_one(symbols: list[int]) -> list[int]:
    """Both phases for one long text, whose last symbol counts as the smallest."""
    n = len(symbols)
    places: dict[int, list[int]] = {}
    for i, s in enumerate(symbols[:-1]):
        places.setdefault(s, []).append(i + 1)
    order, group, size = [n], [-1] * (n + 1), [0] * n
    group[n], size[0] = 0, 1
    for s in sorted(places):
        start = len(order)
        size[start] = len(places[s])
        for i in places[s]:
            group[i] = start
        order += places[s]
    where = [0] * (n + 1)
    for k, i in enumerate(order):
        where[i] = k
    before, high = [0] * (n + 1), n
    while high > 0:
        g = group[order[high - 1]]
        counts: dict[int, int] = {}
        for i in sorted(order[g:high]):
            j = i - 1
            while group[j] > g:
                j = before[j]
            if group[j] == g:
                j = before[j]
            before[i] = j
            if j:
                counts[j] = counts.get(j, 0) + 1
        leaving: dict[int, list[tuple[int, int]]] = {}
        for j, c in counts.items():
            leaving.setdefault(group[j], []).append((c, j))
        for old, moved in leaving.items():
            moved.sort(reverse=True)
            end, k = old + size[old], 0
            size[old] -= len(moved)
            while k < len(moved):
                begin, c = k, moved[k][0]
                while k < len(moved) and moved[k][0] == c:
                    j, end = moved[k][1], end - 1
                    other, at = order[end], where[j]
                    order[at], order[end] = other, j
                    where[other], where[j] = at, end
                    k += 1
                size[end] = k - begin
                for _, j in moved[begin:k]:
                    group[j] = end
        high = g
    out, slot, done = [0] * n, list(range(n)), [False] * (n + 1)
    out[0], slot[0], done[n], done[0] = n, 1, True, True
    for i in range(n):
        j = out[i] - 1
        while not done[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            done[j] = True
            j = before[j]
    return [i - 1 for i in out]


def suffix_orders(flat: np.ndarray, starts: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix arrays of texts that lie one after another in ``flat``, each ended by a symbol that counts as its smallest.

    Gives (texts, order): numbers of texts, and for each a row of places in its suffix order, -1 beyond its end.
    Texts of like length go together.
    """
    sizes = np.diff(np.r_[starts, len(flat)])
    by_size = np.argsort(sizes, kind="stable")
    short = by_size[: np.searchsorted(sizes[by_size], TOGETHER, side="right")]
    low = 0
    while low < len(short):
        high = low + max(1, int(np.searchsorted(np.arange(1, len(short) - low + 1) * sizes[short[low:]], most, side="right")))
        rows = short[low:high]
        cols = np.arange(sizes[rows[-1]])
        inside = cols < sizes[rows][:, None]
        symbols = np.zeros(inside.shape, dtype=np.int16)
        symbols[inside] = flat[(starts[rows][:, None] + cols)[inside]]
        yield rows, emit_order(*group_suffixes(symbols, sizes[rows]), sizes[rows])
        low = high
    for r in by_size[len(short) :]:
        yield np.array([r]), np.array([order_one(flat[starts[r] : starts[r] + sizes[r]].tolist())])


# -- anchors ---------------------------------------------------------------------------------------------------------


def _rolled(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes, by doubling."""
    x = (data.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    power, power_n, out, out_n = x, 1, None, 0
    while n:
        if n & 1:
            if out is None:
                out, out_n = power, power_n
            else:
                m = len(power) - out_n
                out = out[:m] * _U(pow(_BASE, power_n, 1 << 64)) + power[out_n : out_n + m]
                out_n += power_n
        n >>= 1
        if n:
            m = len(power) - power_n
            power = power[:m] * _U(pow(_BASE, power_n, 1 << 64)) + power[power_n:]
            power_n *= 2
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def runs_of_windows(texts: list[bytes], part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) for each run of windows of a text with the same anchor of ``part`` bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.view(_U)
    least, span = _mixed(_rolled(data, part)), 1
    want = LENGTH - part + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - LENGTH + 1
    least = np.minimum(least[:n], least[want - span : want - span + n])
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text[:n] == text[LENGTH - 1 :])
    anchor, text = least[at], text[at]
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[begin, len(at)])
    # Text that repeats itself gives long runs; they go in pieces of as many windows as a mask has bits for.
    pieces = -(-count // MOST_WINDOWS)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, count = np.repeat(begin, pieces) + number * MOST_WINDOWS, np.minimum(MOST_WINDOWS, np.repeat(count, pieces) - number * MOST_WINDOWS)
    return text[begin], at[begin] - (np.cumsum(sizes) - sizes)[text[begin]], count, anchor[begin]


def _deal(bucket: np.ndarray, most: int = 1 << 30) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the numbers of its rows, ``most`` at a time."""
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    for part in np.split(order, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1):
        for low in range(0, len(part), most):
            yield int(bucket[part[0]]), part[low : low + most]


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _anchors(buckets: int):
    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, name = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = list(_deal(anchor % _U(buckets), ROW_ANCHORS))
        for low, high in slices([16 * len(i) for _, i in rows]):
            some = rows[low:high]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some]), _binary([anchor[i] for _, i in some]), _binary([name[i] for _, i in some])], names=["bucket", "anchors", "names"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CUT_BYTES):
                names = dict(zip(batch.column("h1").slice(low, high - low).to_pylist(), utf8(texts.slice(low, high - low)), strict=True))
                ids = np.array(list(names), dtype=np.int64)
                text, _, _, anchor = runs_of_windows(list(names.values()))
                held.append((anchor, ids[text]))
                size += sum(map(len, names.values()))
                if size >= DEALT_BYTES:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    return run


def _buckets(batches: Iterator[pa.RecordBatch], columns: dict[str, str], least: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """The blobs of a partition sorted by bucket, one array for each column, and whether a bucket ends there.

    Comes out once ``least`` bytes have gathered: at the end of a bucket, or, where there is no end in sight, in between.
    """
    held: dict[str, list[bytes]] = {c: [] for c in columns}
    size, last = 0, None

    def taken() -> dict[str, np.ndarray]:
        out = {c: np.frombuffer(b"".join(held[c]), dtype=kind) for c, kind in columns.items()}
        for c in columns:
            held[c].clear()
        return out

    for batch in batches:
        blobs = [batch.column(c).to_pylist() for c in columns]
        for bucket, *row in zip(batch.column("bucket").to_pylist(), *blobs, strict=True):
            if bucket != last and size >= least:
                yield taken(), True
                size = 0
            elif size >= 8 * least:
                yield taken(), False
                size = 0
            last = bucket
            for c, blob in zip(columns, row, strict=True):
                held[c].append(blob)
                size += len(blob)
    yield taken(), True


def _shared(hot_texts: int, least: int = 1 << 26):
    """For each text (h1), its anchors in this partition that other texts have too. Rows without h1 tell what is hot:
    an anchor and its number of texts if that is over ``hot_texts``, and without anchor the number of all.

    Of a bucket that does not fit, each anchor is held with its first text, and the others come out as they come by.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=_U)
        known, firsts, told, counts = none, none.view(np.int64), none.astype(bool), none.view(np.int64)
        total, hot = 0, []
        for got, ended in _buckets(batches, {"anchors": "<u8", "names": "<i8"}, least):
            anchor, name = np.r_[known, got["anchors"]], np.r_[firsts, got["names"]]
            old = np.arange(len(anchor)) < len(known)
            order = np.lexsort((name, ~old, anchor))  # the first text of an anchor stays its first
            anchor, name, old = anchor[order], name[order], old[order]
            begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, dtype=np.int64)
            of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(anchor)]))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])][: len(anchor)]
            other = new & (name != name[begin][of])  # a text besides the first
            several = np.bincount(of, weights=other, minlength=len(begin)) > 0
            seen = np.zeros(len(begin), dtype=bool)
            seen[of[old]] = told[order[old]]
            number = np.bincount(of, weights=other, minlength=len(begin)).astype(np.int64) + 1
            number[of[old]] += counts[order[old]] - 1
            emit = other.copy()
            emit[begin[several & ~seen]] = True
            told_anchor, rows = anchor[emit], list(_deal(name[emit]))
            for low in range(0, len(rows), 20000):
                part = rows[low : low + 20000]
                yield _told(pa.array([n for n, _ in part], pa.int64()), _binary([told_anchor[i] for _, i in part]))
            known, firsts, told, counts = anchor[begin], name[begin], seen | several, number
            if ended:
                total += int(number.sum())
                hot += [(a, int(n)) for a, n in zip(known[number > hot_texts].view(np.int64).tolist(), number[number > hot_texts], strict=True)]
                known, firsts, told, counts = none, none.view(np.int64), none.astype(bool), none.view(np.int64)
        yield _told(pa.nulls(len(hot) + 1, pa.int64()), pa.nulls(len(hot) + 1, pa.binary()), [a for a, _ in hot] + [None], [n for _, n in hot] + [total])

    return run


def _told(h1: pa.Array, anchors: pa.Array, anchor: list | None = None, n: list | None = None) -> pa.RecordBatch:
    none = [None] * len(h1)
    return pa.RecordBatch.from_arrays([h1, anchors, pa.array(anchor or none, pa.int64()), pa.array(n or none, pa.int64())], names=["h1", "anchors", "anchor", "n"])


def _hot_anchors(shared: DataFrame, hot_texts: int) -> np.ndarray:
    """Anchors (sorted) of over ``hot_texts`` texts, or a millionth of all pairs of a text and an anchor, so a million at most."""
    told = shared.where("h1 is null")
    total = told.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    got = told.where(F.col("n") > max(hot_texts, total // 1_000_000)).where("anchor is not null").select("anchor").toArrow()
    return np.sort(got.column("anchor").to_numpy().view(_U))


def _strings(buckets: int, hot):
    """The strings under shared anchors, with the windows that are to be judged there, dealt by anchor. hot: broadcast of _hot_anchors."""

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        body = [x for *_, pieces in held for x in pieces]
        columns = [np.concatenate(x) for x in list(zip(*held, strict=True))[:-1]]
        rows = list(_deal(_mixed(columns[0]) % _U(buckets), ROW_STRINGS))
        for low, high in slices([100 * len(i) for _, i in rows]):
            some = rows[low:high]
            blobs = [_binary([x[i] for _, i in some]) for x in columns]
            blobs.append(pa.array([b"".join([body[k] for k in i.tolist()]) for _, i in some], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some]), *blobs], names=["bucket", "anchors", "sizes", "judges", "places", "names", "firsts", "body"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_pylist(), CUT_BYTES):
                own = utf8(texts.slice(low, high - low))
                text, first, count, anchor = runs_of_windows(own)
                known = [np.frombuffer(b"".join(x), dtype="<u8") for x in batch.column("anchors").slice(low, high - low).to_pylist()]
                owner = np.repeat(np.arange(len(own)), [len(k) for k in known])
                known = np.concatenate(known)
                # One number for text and anchor; a chance hit only adds a string that no other text shares.
                table = _mixed(known + owner.astype(_U) * _U(_BASE))
                table, wanted = np.sort(table), _mixed(anchor + text.astype(_U) * _U(_BASE))
                at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
                found = table[at] == wanted if len(table) else np.zeros(len(text), dtype=bool)
                text, first, count, anchor = text[found], first[found], count[found], anchor[found]
                if len(hot.value):
                    at = np.minimum(np.searchsorted(hot.value, anchor), len(hot.value) - 1)
                    text, first, count, anchor = _spread(own, text, first, count, anchor, hot.value[at] == anchor)
                place = batch.column("place").slice(low, high - low).to_numpy()
                h1 = batch.column("h1").slice(low, high - low).to_numpy()
                judge = ((_U(1) << count.astype(_U)) - _U(1)).astype("<u4")
                pieces = [own[t][f : f + n] for t, f, n in zip(text.tolist(), first.tolist(), (count + LENGTH - 1).tolist(), strict=True)]
                held.append((anchor, (count + LENGTH - 1).astype("<u2"), judge, place[text], h1[text], first.astype("<u4"), pieces))
                size += sum(map(len, own))
                if size >= DEALT_BYTES:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    return run


def _second(strings: list[bytes], anchor: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, number of windows, name of both anchors) for each run of windows with the same second anchor."""
    own, first, count, second = runs_of_windows(strings, part)
    return own, first, count, _mixed(_mixed(second) + anchor[own] * _U(_BASE))


def _spread(own: list[bytes], text, first, count, anchor, hot):
    """Strings under hot anchors go in pieces to the groups that their second anchors name."""
    some = np.flatnonzero(hot)
    strings = [own[t][f : f + n] for t, f, n in zip(text[some].tolist(), first[some].tolist(), (count[some] + LENGTH - 1).tolist(), strict=True)]
    of, begin, n, name = _second(strings, anchor[some], HOT_PART)
    pieces = text[some][of], first[some][of] + begin, n, name
    return [np.r_[x[~hot], y] for x, y in zip((text, first, count, anchor), pieces, strict=True)]


@tidy
def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, its windows that a smaller document has too: (first window, mask) of runs."""
    kinds = {"anchors": "<u8", "sizes": "<u2", "judges": "<u4", "places": "<i8", "names": "<i8", "firsts": "<u4", "body": "u1"}
    held = None  # of a bucket that does not end yet
    for got, ended in _buckets(batches, kinds, JUDGED_BYTES):
        held = got if held is None else {c: np.r_[held[c], got[c]] for c in kinds}
        if ended:
            if len(held["anchors"]):
                yield from _judge(held)
            held = None


def _judge(got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    mask = _late_windows(got)
    hit = np.flatnonzero(mask)
    name, place, first, mask = got["names"][hit], got["places"][hit], got["firsts"][hit], mask[hit].astype("<u4")
    rows = [i for _, i in _deal(name)]
    for low in range(0, len(rows), 20000):
        part = rows[low : low + 20000]
        yield pa.RecordBatch.from_arrays([pa.array([place[i[0]] for i in part], pa.int64()), pa.array([name[i[0]] for i in part], pa.int64()), _binary([first[i] for i in part]), _binary([mask[i] for i in part])], names=["place", "h1", "firsts", "masks"])


def _late_windows(got: dict[str, np.ndarray], large: int | None = LARGE) -> np.ndarray:
    """For each string, a mask of the windows that a smaller document has under the same anchor.

    Groups of over ``large`` symbols are cut again by second anchors; with None no more.
    """
    sizes = got["sizes"].astype(np.int64)
    ends, body = np.cumsum(sizes), got["body"].tobytes()
    begins = ends - sizes
    digest = xxhash.xxh3_64_intdigest
    hashed = np.array([digest(body[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], dtype=_U)
    order = np.lexsort((got["places"], hashed, got["judges"], got["anchors"]))
    same = lambda x: x[order][1:] == x[order][:-1]
    new_anchor = np.r_[True, ~same(got["anchors"])]
    new_string = np.r_[True, ~(same(got["anchors"]) & same(hashed) & same(got["judges"]))]
    again = np.flatnonzero(~new_string)
    new_string[again] = ~_equal(got["body"], begins, sizes, order[again], order[again - 1])
    string_at = np.flatnonzero(new_string)
    string = np.cumsum(new_string) - 1  # of each row in order
    least = got["places"][order][string_at]  # the smallest document of each different string
    anchor_at = np.flatnonzero(new_anchor[string_at])
    in_group = np.diff(np.r_[anchor_at, len(string_at)])
    early = np.zeros(len(string_at), dtype=np.uint32)  # windows that a smaller document has in another string
    head = order[string_at]
    several = np.flatnonzero(in_group > 1)
    if large is not None:
        wide = np.add.reduceat(sizes[head] + 1, anchor_at)[several] > large
        own = _ragged(anchor_at[several[wide]], in_group[several[wide]])
        _judge_large(own, got["anchors"][head], begins[head], sizes[head], body, got["judges"][head], least, early)
        several = several[~wide]
    for low in range(0, len(several), 20000):
        _judge_groups(several[low : low + 20000], anchor_at, in_group, head, begins, sizes, got["body"], got["judges"], least, early)
    mask = np.empty(len(order), dtype=np.uint32)
    mask[order] = np.where(got["places"][order] > least[string], got["judges"][order], early[string])
    return mask


def _judge_large(own: np.ndarray, anchors, begins, sizes, body: bytes, judges, least, early) -> None:
    """Judges the strings ``own`` of large groups under second anchors, those that several of them share."""
    runs = []
    for low, high in slices(sizes[own].tolist(), CUT_BYTES):
        some = own[low:high]
        strings = [body[a : a + n] for a, n in zip(begins[some].tolist(), sizes[some].tolist(), strict=True)]
        of, first, count, name = _second(strings, anchors[some], LARGE_PART)
        runs.append((some[of], first, count, name))
    if not runs:
        return
    of, first, count, name = (np.concatenate(x) for x in zip(*runs, strict=True))
    by = np.lexsort((of, name))
    begin = np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]])
    last = np.r_[begin[1:], len(by)] - 1
    by = by[np.repeat(of[by][begin] != of[by][last], last + 1 - begin)]
    of, first, count, name = of[by], first[by], count[by], name[by]
    if not len(of):
        return
    size = count + LENGTH - 1
    got = {
        "anchors": name, "sizes": size, "judges": judges[of] >> first.astype(np.uint32) & ((np.uint32(1) << count.astype(np.uint32)) - np.uint32(1)),
        "places": least[of], "body": np.frombuffer(body, dtype=np.uint8)[_ragged(begins[of] + first, size)],
    }
    np.bitwise_or.at(early, of, _late_windows(got, None) << first.astype(np.uint32))


def _equal(body: np.ndarray, begins: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the strings x[i] and y[i] are the same bytes."""
    out = sizes[x] == sizes[y]
    for low in range(0, len(x), 1 << 15):
        p, q = x[low : low + (1 << 15)], y[low : low + (1 << 15)]
        n = np.minimum(sizes[p], sizes[q])
        differs = body[_ragged(begins[p], n)] != body[_ragged(begins[q], n)]
        out[low : low + (1 << 15)] &= ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return out


def _judge_groups(groups, anchor_at, in_group, head, begins, sizes, body, judges, least, early) -> None:
    """Orders the suffixes of each group's strings; windows that are equal stand together."""
    number = np.repeat(np.arange(len(groups)), in_group[groups])
    first_of = np.cumsum(in_group[groups]) - in_group[groups]
    own = anchor_at[groups][number] + np.arange(len(number)) - first_of[number]  # strings, group by group
    lengths = sizes[head[own]]
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    which = np.repeat(np.arange(len(own)), lengths + 1)
    offset = np.arange(len(which)) - begin[which]
    flat = np.zeros(len(which), dtype=np.int16)  # 0 ends each string
    letter = offset < lengths[which]
    flat[letter] = body[(begins[head[own]][which] + offset)[letter]].astype(np.int16) + 1
    window = offset <= lengths[which] - LENGTH
    hashed = np.r_[_rolled(flat, LENGTH), np.zeros(LENGTH - 1, dtype=_U)]
    views = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    mine, starts = least[own][which], begin[first_of]
    for rows, order in suffix_orders(flat, starts):
        inside = order >= 0
        at = (starts[rows][:, None] + order)[inside]
        text = np.repeat(np.arange(len(rows)), inside.sum(axis=1))
        keep = window[at]
        at, text = at[keep], text[keep]
        same = np.flatnonzero((hashed[at[1:]] == hashed[at[:-1]]) & (text[1:] == text[:-1]))
        differs = np.ones(len(at), dtype=bool)
        for low in range(0, len(same), 1 << 15):
            some = same[low : low + (1 << 15)]
            differs[some + 1] = (views[at[some]] != views[at[some + 1]]).any(axis=1)
        class_at = np.flatnonzero(differs)
        small = np.repeat(np.minimum.reduceat(mine[at], class_at), np.diff(np.r_[class_at, len(at)]))
        late = at[small < mine[at]]
        np.bitwise_or.at(early, own[which[late]], np.uint32(1) << offset[late].astype(np.uint32))
    early[own] &= judges[head[own]]


# -- the operator ----------------------------------------------------------------------------------------------------


def removed_spans(size: int, copy: bool, firsts: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a text, from its removed windows; a copy of an earlier text loses all."""
    if copy and size >= LENGTH:
        return [(0, size)]
    if not len(firsts):
        return []
    bits = (masks[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    row, bit = np.nonzero(bits)
    at = np.unique(firsts[row].astype(np.int64) + bit)
    cut = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + LENGTH])
    return list(zip(at[cut].tolist(), (at[np.r_[cut[1:] - 1, len(at) - 1]] + LENGTH).tolist(), strict=True))


@tidy
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(pc.binary_length(texts).to_pylist(), 4 << 20):
            part = batch.slice(low, high - low)
            rows = []
            for text, copy, firsts, masks in zip(utf8(part.column("text")), part.column("copy").to_pylist(), part.column("firsts").to_pylist(), part.column("masks").to_pylist(), strict=True):
                spans = removed_spans(len(text), bool(copy), np.frombuffer(b"".join(firsts or []), dtype="<u4"), np.frombuffer(b"".join(masks or []), dtype="<u4"))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rows.append((len(text), [{"first": a, "last": b} for a, b in spans], b"".join(kept)))
            n, spans, kept = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame, buckets: int | None = None, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``: the removed byte ranges, and the bytes that are left.

    A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id; strings
    are judged on the input and never cross documents. A null text is empty. Rows that repeat a doc_id are not
    smaller than each other; a null doc_id comes after all others. Other columns are ignored; an empty table
    gives an empty result. Equal texts take part once, under their smallest doc_id, and the others lose all
    of their 50 bytes or more; texts are told apart by 128 bits of hash.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    partitions = shuffle_partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LATEST)).alias("place"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    names = scratch.save(rows.select("place", "h1", "h2", F.octet_length("text").alias("size")).distinct())
    size = names.agg(F.sum("size")).first()[0] or 0
    buckets = buckets or partitions * max(1, -(-size // (partitions * BUCKET_BYTES)))  # as many in each partition
    dealt = lambda df: df.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int")).sortWithinPartitions("bucket")
    least = scratch.save(names.groupBy("h1", "h2").agg(F.min("place").alias("place")))
    anchors = rows.select("h1", "text").mapInArrow(_anchors(buckets), "bucket long, anchors binary, names binary")
    shared = scratch.save(dealt(anchors).mapInArrow(_shared(hot_texts), "h1 long, anchors binary, anchor long, n long"))
    hot = spark.sparkContext.broadcast(_hot_anchors(shared, hot_texts))  # a million pairs of numbers at most
    wanted = shared.where("h1 is not null").groupBy("h1").agg(F.collect_list("anchors").alias("anchors"))
    wanted = least.join(wanted, "h1")
    found = rows.join(wanted, ["place", "h1", "h2"]).select("place", "h1", "text", "anchors")
    strings = found.mapInArrow(_strings(buckets, hot), "bucket long, anchors binary, sizes binary, judges binary, places binary, names binary, firsts binary, body binary")
    judged = scratch.save(dealt(strings).mapInArrow(_judged, "place long, h1 long, firsts binary, masks binary"))
    scratch.drop(shared)
    windows = judged.groupBy("place", "h1").agg(F.collect_list("firsts").alias("firsts"), F.collect_list("masks").alias("masks"))
    copies = names.join(least.withColumnRenamed("place", "least"), ["h1", "h2"]).withColumn("copy", F.col("place") > F.col("least")).drop("least", "size")
    verdicts = copies.join(windows, ["place", "h1"], "left").where("copy or firsts is not null")
    joined = rows.join(verdicts, ["place", "h1", "h2"], "left").select("doc_id", "text", "copy", "firsts", "masks")
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    got = dedup_substrings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
