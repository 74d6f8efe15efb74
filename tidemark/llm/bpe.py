"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut into chunks where a rolling hash of eight bytes falls below a bound, so passages that documents
share give the same chunks. A chunk is encoded once in a task and kept under its 128-bit hash; of a chunk only its
core, the words between its first and its last white space, can be reused as it is. Joins are repaired: what
stands around a cut is re-encoded, over as many chunks as it takes to reach white space on both sides, where the
encodings agree exactly because the tokenizer drops white space and never merges across it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, utf8

#: One cut in so many bytes, on average.
CHUNK_BYTES = 512
#: Chunks kept for each task: the last so many, and as many before them. A chunk that is met again counts as new.
KEPT_CHUNKS = 20_000
#: Pieces and parts kept for each task; a full store is emptied. All stores are emptied when the task ends.
KEPT_PIECES = 400_000
#: Texts are encoded in slices of about so many bytes.
ENCODED_BYTES = 3 << 17

#: Parts of more bytes than this go through the library.
LONGEST = 32

#: The tokenizer's own pattern for parts of a piece (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = regex.compile(_PATTERN)
_SPACE = frozenset(b" \t\n\r\v\f")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def cuts(data: np.ndarray, one_in: int) -> np.ndarray:
    """Places in ``data`` after which a chunk ends: those whose last eight bytes hash below a bound."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[: len(x) - shift] | (x[shift:] << np.uint64(8 * shift))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero(x < np.uint64((1 << 64) // one_in)) + 8


class Merges:
    """The merge rules of a byte-level BPE with word ends, applied to many short parts at once."""

    def __init__(self, vocabulary: dict[str, int], rules: list, suffix: str):
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        chars = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocabulary[chars[c]] for c in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[chars[c] + suffix] for c in range(256)], dtype=np.int64)
        pairs = [r if isinstance(r, list | tuple) else r.split(" ") for r in rules]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.never = np.int32(len(pairs))

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """The rules, if the tokenizer is of the kind that this class and _PARTS describe; else None."""
        import json

        t = json.loads(tokenizer.to_str())
        model, normal, split = t["model"], t.get("normalizer") or {}, (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kind = [n.get("type") for n in normal.get("normalizers", [])], split[0].get("pattern", {}).get("Regex"), [x.get("type") for x in split]
        if kind != (["NFC", "Replace", "Lowercase"], _PATTERN, ["Split", "ByteLevel"]) or model["type"] != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            return None
        return cls(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], self.never)

    def encode(self, parts: list[str], names: list[str]) -> list[tuple[bytes, str]]:
        """Ids as bytes and token strings of each part of 1 to LONGEST bytes: the rule of lowest rank, leftmost first, until none fits."""
        coded = [p.encode() for p in parts]
        sizes = np.array([len(c) for c in coded])
        flat, begins = np.frombuffer(b"".join(coded), dtype=np.uint8), np.cumsum(sizes) - sizes
        out: list = [None] * len(parts)
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LONGEST)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for some in np.array_split(rows, max(1, len(rows) // 4000)):
                n, cols = sizes[some], np.arange(high)
                inside = cols < n[:, None]
                symbols = np.full((len(some), high + 1), -1, dtype=np.int64)
                symbols[:, :high][inside] = self.inner[flat[(begins[some][:, None] + cols)[inside]]]
                symbols[np.arange(len(some)), n - 1] = self.last[flat[begins[some] + n - 1]]
                ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
                live, place = np.arange(len(some)), np.arange(high + 1)
                done = symbols.copy()
                while len(live):
                    best = ranks.argmin(axis=1)
                    rule = ranks[np.arange(len(best)), best]
                    going = rule < self.never
                    done[live[~going]] = symbols[~going]
                    live, symbols, ranks, best, rule = live[going], symbols[going], ranks[going], best[going], rule[going]
                    if not len(live):
                        break
                    source = np.minimum(place + (place > best[:, None]), high)
                    symbols = np.take_along_axis(symbols, source, axis=1)
                    symbols[:, high] = -1
                    ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], high - 1), axis=1)
                    ranks[:, high - 1] = self.never
                    every = np.arange(len(live))
                    symbols[every, best] = self.made[rule]
                    ranks[every, best] = self.rank(symbols[every, best], symbols[every, best + 1])
                    left = np.flatnonzero(best > 0)
                    ranks[left, best[left] - 1] = self.rank(symbols[left, best[left] - 1], symbols[left, best[left]])
                used = done >= 0
                ids, counts = done[used].astype("<u4"), used.sum(axis=1)
                data, ends, text = ids.tobytes(), np.cumsum(counts).tolist(), [names[i] for i in ids.tolist()]
                begin = 0
                for i, end in zip(some.tolist(), ends, strict=True):
                    out[i] = data[4 * begin : 4 * end], text[begin] if end - begin == 1 else " ".join(text[begin:end])
                    begin = end
        return out


class Encoder:
    """Encodes whole texts with one tokenizer; keeps what it has encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if plain(" \t\n") or plain("a b") != plain("a") + plain("b"):
            raise ValueError("the tokenizer must drop white space")
        self.merges = Merges.of(self.tokenizer)
        self.chunks: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}
        self.kept_chunks, self.kept_pieces = KEPT_CHUNKS, KEPT_PIECES
        self.bytes = self.reused = 0  # in all, and in chunks that were kept
        self.pieces: dict[bytes, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}

    def _run(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit numbers, token strings with blanks between) of each text, by the library."""
        got, out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), []
        for e in got:
            ids = e.ids
            out.append((np.array(ids, dtype="<u4").tobytes(), " ".join([self.names[i] for i in ids])))
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces, which hold no ASCII white space, that are not kept yet."""
        if len(self.pieces) + len(pieces) > self.kept_pieces:
            self.pieces.clear()
        if len(self.parts) > self.kept_pieces:
            self.parts.clear()
        single, several, whole, fresh, parts = [], [], [], {}, self.parts
        for piece in pieces:
            text = piece.decode()
            # Letters below this one are in composed form and lower-cased one by one, so their parts stand for themselves.
            if not self.merges or max(text) >= "İ" or any(s in text for s in self.special):
                whole.append((piece, text))
                continue
            text = text.lower()
            if text.isalpha():
                single.append((piece, text))
                if text not in parts:
                    fresh[text] = None
            else:
                several.append((piece, found := _PARTS.findall(text)))
                fresh.update([(p, None) for p in found if p not in parts])
        short = [p for p in fresh if len(p) <= LONGEST // 2]
        parts.update(zip(short, self.merges.encode(short, self.names) if short else (), strict=True))
        long = [p for p in fresh if len(p) > LONGEST // 2]
        parts.update(zip(long, self._run(long), strict=True))
        self.pieces.update([(piece, parts[text]) for piece, text in single])
        for piece, found in several:
            got = [parts[p] for p in found]
            self.pieces[piece] = b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])
        self.pieces.update(zip([p for p, _ in whole], self._run([t for _, t in whole]), strict=True))

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """For each text its ids, as bytes, and its decoded text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the stores hold many objects to look through
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        at = cuts(np.frombuffer(data, dtype=np.uint8), CHUNK_BYTES)
        owner = np.searchsorted(ends, at, side="left")
        at = at[(owner < len(ends)) & (at - (ends - [len(t) for t in texts])[np.minimum(owner, len(ends) - 1)] >= 8)]
        bounds = np.union1d(at, ends).tolist()
        if len(self.chunks) > self.kept_chunks:
            self.older, self.chunks = self.chunks, {}
        self.bytes += len(data)
        digest, kept, older = xxhash.xxh3_128_digest, self.chunks, self.older
        # Which chunks are new, and which pieces do they and the joins need?
        docs, begin, k, need, fresh = [], 0, 0, set(), {}
        for end in ends.tolist():
            parts: list = []  # chunks, and the pieces that stand at their joins
            carry = b""
            while begin < end:
                chunk = data[begin : bounds[k]]
                begin = bounds[k]
                k += 1
                name = digest(chunk)
                known = kept.get(name) or fresh.get(name)
                if known is None and (known := older.get(name)):
                    kept[name] = known
                if known is None:
                    known = fresh[name] = self._cut_up(chunk)
                    need.update(known[3])
                else:
                    self.reused += len(chunk)
                if known[0] is None:
                    carry += chunk
                    continue
                if carry or known[0]:
                    parts.append(carry + known[0])
                parts.append(known)
                carry = known[1]
            while k < len(bounds) and bounds[k] <= begin:
                k += 1
            if carry:
                parts.append(carry)
            need.update([p for p in parts if type(p) is bytes])
            docs.append(parts)
        pieces = self.pieces
        missing = need.difference(pieces)
        if missing:
            if len(pieces) + len(missing) > self.kept_pieces:
                missing = need
            self._learn(list(missing))
        for name, (head, tail, core, words) in fresh.items():
            got = [pieces[w] for w in words]
            core.append(b"".join([g[0] for g in got]))
            core.append(" ".join([g[1] for g in got if g[1]]))
            kept[name] = (head, tail, core[0])
        out = []
        for parts in docs:
            got = [pieces[p] if type(p) is bytes else p[2] if len(p) == 4 else (p[2], self._text(p[2])) for p in parts]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out

    def _text(self, ids: bytes) -> str:
        """The token strings of a kept chunk, which are not kept with it to save memory."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def forget(self) -> None:
        for store in (self.chunks, self.older, self.pieces, self.parts):
            store.clear()

    @staticmethod
    def _cut_up(chunk: bytes) -> tuple:
        """(head, tail, core to fill, words of the core); head is None if the chunk has no white space."""
        words = chunk.split()
        head = tail = b""
        if chunk[0] not in _SPACE:
            head = words.pop(0)
            if len(head) == len(chunk):
                return None, None, [], ()
        if words and chunk[-1] not in _SPACE:
            tail = words.pop()
        return head, tail, [], words


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), ENCODED_BYTES):
            got = encoder.encode(utf8(texts.slice(low, high - low)))
            n = np.array([len(g[0]) // 4 for g in got], dtype=np.int64)
            if packed:
                ids = pa.array([g[0] for g in got], pa.binary())
            else:
                flat = np.frombuffer(b"".join([g[0] for g in got]), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n), ids, pa.array([g[1] for g in got], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, tokenizer: str | None = None, packed: bool = False, kept_chunks: int = KEPT_CHUNKS, kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``.

    ids is array<int>, or with ``packed`` binary (little-endian 32-bit numbers); decoded is what the library's
    decode gives for them. Equal to encoding the whole text with add_special_tokens=False. A null text is
    empty and has no tokens; repeated rows and null ids come back as they are; other columns are ignored. The
    tokenizer's file must be at the same path on every machine. A task keeps ``kept_chunks`` to twice as many chunks for
    reuse, of about 700 bytes each, and up to ``kept_pieces`` words and as many parts of words; the result does not
    depend on them.
    """
    path = tokenizer or default_tokenizer()
    kind = "binary" if packed else "array<int>"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        encoder.kept_chunks, encoder.kept_pieces = kept_chunks, kept_pieces
        try:
            yield from _encoded(encoder, batches, packed)
        finally:
            encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {kind}, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""
    got = encode(docs, tokenizer, packed=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
