"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Every word enters as its own vector joined with the mean vector of its character trigrams. Texts are cut into
overlapping windows; a window's hidden states of both directions are pooled by attention into one logit, and a
text's score is that of its worst window. Labels are known for whole texts only, so training weighs the windows
of a text by a softmax of their logits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, utf8
from .labelled import held_out, sample

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
TRIGRAMS = 1 << 15

#: A-Z lower-cased; letters and bytes from 80 up are word bytes, all other bytes separate words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Longer texts and words go through in parts of about so many bytes.
PART_BYTES = 1 << 20
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts of about PART_BYTES or one word."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + PART_BYTES)
        end = found.start() if found else len(text)
        yield words_of(text[at:end])
        at = end


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of each word, with a mark at both ends: flat numbers and each word's first place."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8).astype(np.uint32)
    codes = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    keep = np.ones(len(codes), dtype=bool)
    keep[begins[1:] - 1] = False  # trigrams around the mark between two words
    return codes[keep], np.cumsum(sizes) - sizes


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    shift: float = 0.0

    @staticmethod
    def new(vocabulary: list[bytes], seed: int = 3) -> Network:
        rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        p = {"words": draw(len(vocabulary) + 1, WORD_DIM) * 0.1, "chars": draw(TRIGRAMS, CHAR_DIM) * 0.3}
        p["words"][-1] = 0  # all words outside the vocabulary
        for side in "fb":
            p |= {f"x{side}": draw(d, 3 * HIDDEN) / np.sqrt(d) * 2, f"c{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": draw(HIDDEN, 2 * HIDDEN) / np.sqrt(HIDDEN), f"n{side}": draw(HIDDEN, HIDDEN) / np.sqrt(HIDDEN)}
        p |= {"attend": draw(2 * HIDDEN) * 0.3, "out": draw(2 * HIDDEN) * 0.5, "bias": np.zeros(1, np.float32)}
        return Network({w: i for i, w in enumerate(vocabulary)}, p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of distinct words, with the vocabulary numbers, trigrams and first places behind them."""
        known = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words])
        grams, first = trigrams(words)
        counts = np.diff(np.r_[first, len(grams)]).astype(np.float32)
        means = np.add.reduceat(self.p["chars"][grams], first, axis=0) / counts[:, None]
        return np.hstack([self.p["words"][known], means]), known, grams, first

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Input vectors as ``inputs`` gives them, with little memory for long words."""
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), np.float32)
        for low, high in slices([len(w) for w in words], PART_BYTES):
            if len(words[low]) <= PART_BYTES:
                out[low:high] = self.inputs(words[low:high])[0]
                continue
            counts, word = np.zeros(TRIGRAMS), words[low]
            for at in range(0, len(word), PART_BYTES):
                piece = (b"\0" if at == 0 else word[at - 1 : at]) + word[at : at + PART_BYTES + 1]
                counts += np.bincount(trigrams([piece + b"\0" * (len(word) <= at + PART_BYTES)])[0][1:-1], minlength=TRIGRAMS)
            out[low, :WORD_DIM] = self.p["words"][self.vocabulary.get(word, len(self.vocabulary))]
            out[low, WORD_DIM:] = counts @ self.p["chars"] / counts.sum()
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; index[t, window] is the word at step t, mask tells the real ones."""
        steps, n = index.shape
        states, tape = {}, {}
        for side in "fb":
            p = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
            u, un = self.p[f"u{side}"], self.p[f"n{side}"]
            h, hs = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
            for t in range(steps) if side == "f" else reversed(range(steps)):
                a = p[index[t]]
                zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + h @ u)))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ un)
                m = mask[t][:, None]
                before, h = h, h + m * (1 - z) * (new - h)
                hs[t] = h
                if keep:
                    tape[side, t] = before, z, r, new
            states[side] = hs
        both = np.concatenate([states["f"], states["b"]], axis=2)
        e = np.where(mask > 0, both @ self.p["attend"], -1e9)
        weight = np.exp(e - e.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbd->bd", weight, both)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, (both, weight, pooled, tape)

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of ``x``."""
        both, weight, pooled, tape = kept
        g = {"bias": np.array([dlogit.sum()]), "out": pooled.T @ dlogit}
        dpooled = dlogit[:, None] * self.p["out"]
        dweight = np.einsum("bd,tbd->tb", dpooled, both)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["attend"] = np.einsum("tb,tbd->d", de, both)
        dboth = weight[:, :, None] * dpooled + de[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for side, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, un, w = self.p[f"u{side}"], self.p[f"n{side}"], self.p[f"x{side}"]
            du, dun, da = np.zeros_like(u), np.zeros_like(un), np.empty((*index.shape, 3 * HIDDEN), np.float32)
            dh = np.zeros_like(both[0][:, :HIDDEN])
            order = reversed(range(len(index))) if side == "f" else range(len(index))
            for t in order:
                before, z, r, new = tape[side, t]
                dh = dh + dboth[t][:, cols]
                m = mask[t][:, None]
                dnew = dh * m * (1 - z) * (1 - new * new)
                dz = -dh * m * (new - before) * z * (1 - z)
                drh = dnew @ un.T
                dr = drh * before * r * (1 - r)
                dzr = np.hstack([dz, dr])
                du += before.T @ dzr
                dun += (r * before).T @ dnew
                da[t, :, : 2 * HIDDEN], da[t, :, 2 * HIDDEN :] = dzr, dnew
                dh = dh * (1 - m * (1 - z)) + drh * r + dzr @ u.T
            dp = _summed(index.ravel(), da.reshape(-1, 3 * HIDDEN), len(x))
            g |= {f"u{side}": du, f"n{side}": dun, f"x{side}": x.T @ dp, f"c{side}": dp.sum(axis=0)}
            dx += dp @ w.T
        return g, dx


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """out[i]: the sum of the values whose row is i."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out[rows[begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def windows_of(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts with so many words: (text, first word, number of words). No words, no window."""
    counts = np.array(counts, dtype=np.int64)
    n = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(counts) - counts, n) + k * STRIDE
    return text, first, np.minimum(WINDOW, counts[text] - k * STRIDE)


def _layout(words: list[bytes], counts: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for all windows of the texts: text, index[t, window] and mask[t, window]."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    text, first, size = windows_of(counts)
    at = first[None, :] + np.arange(WINDOW)[:, None]
    mask = (np.arange(WINDOW)[:, None] < size).astype(np.float32)
    return list(seen), text, ids[np.minimum(at, len(ids) - 1)], mask


def _window_logits(network: Network, layout: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, logit) of all windows of a layout, some at a time."""
    distinct, text, index, mask = layout
    x = network.vectors(distinct)
    for low in range(0, len(text), 4096):
        part = slice(low, low + 4096)
        yield text[part], network.forward(x, index[:, part], mask[:, part])[0]


def _long_logit(network: Network, text: bytes) -> float:
    """The largest logit of the windows of one long text, of which only some words are held at a time."""
    best, held, past = -np.inf, [], 0
    for words in word_parts(text):
        held += words
        full = (len(held) - WINDOW) // STRIDE + 1  # windows that no further word can change
        if full > 0:
            layout = _layout(held[: (full - 1) * STRIDE + WINDOW], [(full - 1) * STRIDE + WINDOW])
            best = max([best, *(logit.max() for _, logit in _window_logits(network, layout))])
            held, past = held[full * STRIDE :], past + full
    if held and (not past or len(held) > WINDOW - STRIDE):
        best = max([best, *(logit.max() for _, logit in _window_logits(network, _layout(held, [len(held)])))])
    return best


def scores(network: Network, texts: list[bytes]) -> np.ndarray:
    """The score of each whole text: the largest logit of its windows as a chance; 0 without words."""
    counts, words, out = [], [], np.full(len(texts), -np.inf)
    for i, t in enumerate(texts):
        w = words_of(t) if len(t) <= PART_BYTES else []
        if len(t) > PART_BYTES:
            out[i] = _long_logit(network, t)
        counts.append(len(w))
        words += w
    if words:
        for text, logit in _window_logits(network, _layout(words, counts)):
            np.maximum.at(out, text, logit)
    return 1 / (1 + np.exp(-np.clip(out + network.shift, -60, 60).astype(np.float64))) * (out > -np.inf)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * d * d
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def fit(texts: list[bytes], y: np.ndarray, updates: int = 500, batch_windows: int = 800, rate: float = 0.02, embed_rate: float = 0.15, least: int = 4, most_words: int = 20_000, seed: int = 11) -> Network:
    """Trains on whole texts with labels y. Words in at least ``least`` texts, the commonest first, have vectors of their own."""
    split = [words_of(t) for t in texts]
    use = [i for i, w in enumerate(split) if w]
    seen: dict[bytes, int] = {}
    for w in split:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    vocabulary = sorted((x for x, n in seen.items() if n >= least), key=lambda x: (-seen[x], x))[:most_words]
    network = Network.new(vocabulary)
    y = np.asarray(y, dtype=np.float64)
    if len(use) < 20 or y[use].min() == y[use].max():
        network.p["out"][:] = 0
        share = float(np.clip(y.mean() if len(y) else 0.01, 0.01, 0.99))
        network.p["bias"][:] = np.log(share / (1 - share))
        return network
    rng, adam = np.random.default_rng(seed), _Adam(rate)
    squares = {k: np.full(len(network.p[k]), 1e-4, np.float32) for k in ("words", "chars")}
    sides = [[i for i in use if y[i] == k] for k in (0, 1)]
    queue: list[list[int]] = [[], []]
    for u in range(updates):
        batch, total = [], 0
        while total < batch_windows:
            for k in (0, 1):
                if not queue[k]:
                    queue[k] = rng.permutation(sides[k]).tolist()
                batch.append(queue[k].pop())
                total += max(1, -(-(len(split[batch[-1]]) - WINDOW) // STRIDE) + 1)
        distinct, text, index, mask = _layout([w for i in batch for w in split[i]], [len(split[i]) for i in batch])
        x, known, grams, first = network.inputs(distinct)
        logit, kept = network.forward(x, index, mask, keep=True)
        # A text's logit is its windows' mean, weighed by a softmax that sharpens as training goes on.
        sharp = 1.0 + 3.0 * u / updates
        top = np.full(len(batch), -np.inf)
        np.maximum.at(top, text, logit)
        share = np.exp(sharp * (logit - top[text]))
        share /= np.bincount(text, weights=share)[text]
        pooled = np.bincount(text, weights=share * logit)
        slope = (1 / (1 + np.exp(-pooled)) - y[batch]) / len(batch)
        dlogit = (slope[text] * share * (1 + sharp * (logit - pooled[text]))).astype(np.float32)
        g, dx = network.backward(x, index, mask, kept, dlogit)
        adam.rate = rate * (1 - 0.9 * u / updates)
        adam.step(network.p, g)
        counts = np.diff(np.r_[first, len(grams)])
        dchars = np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0)
        for k, rows, d in (("words", known, dx[:, :WORD_DIM]), ("chars", grams, dchars)):
            summed = _summed(rows, d, len(network.p[k]))
            touched = np.flatnonzero(summed.any(axis=1))
            summed = summed[touched]
            squares[k][touched] += (summed**2).mean(axis=1)
            network.p[k][touched] -= embed_rate * (summed / np.sqrt(squares[k][touched])[:, None] + 1e-3 * network.p[k][touched])
        network.p["words"][-1] = 0
    network.shift = _shift(network, [texts[i] for i in use], y[use])
    return network


def _shift(network: Network, texts: list[bytes], y: np.ndarray) -> float:
    """The shift of logits that puts the fewest mistakes of the sample at 0.5; the middle of the best stretch."""
    logit = np.concatenate([scores(network, texts[i : i + 200]) for i in range(0, len(texts), 200)])
    logit = np.log(np.clip(logit, 1e-12, 1 - 1e-12) / (1 - np.clip(logit, 1e-12, 1 - 1e-12)))
    order = np.argsort(logit, kind="stable")
    wrong = np.r_[0, np.cumsum(np.where(y[order] == 1, 1, -1))] + (y == 0).sum()
    cut = np.r_[logit[order[0]] - 2, (logit[order][1:] + logit[order][:-1]) / 2, logit[order[-1]] + 2]
    best = np.flatnonzero(wrong == wrong.min())
    return -float(np.clip(cut[best[len(best) // 2]], -20, 20))


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 4000, most_chars: int = 12_000, **options) -> Network:
    """Fits on at most ``positives`` + ``negatives`` labelled texts; of a text longer than ``most_chars`` on pieces spread over it."""
    got = sample(docs, labels, "toxic", positives, negatives, most_chars).toArrow().sort_by("doc_id")
    return fit(utf8(got.column("text")), got.column("y").to_numpy(), **options)


def score(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, got = batch.column("text"), []
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                got.append(scores(network, utf8(texts.slice(low, high - low))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; score is the chance that toxic is 1.

    Every overlapping window of a whole text is scored and the worst one counts. A null text, like one without
    words, scores 0. Rows that repeat a doc_id are scored one by one, a null doc_id is not held out, other
    columns are ignored, an empty table gives an empty result. With fewer than 20 labelled texts that have words, or
    with texts of one class only, every text with words scores the labels' share (0.01 at least).
    """
    return score(docs, train(docs, labels, **options), threshold)
