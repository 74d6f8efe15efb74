"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on the statistics of a bounded sample, every path from a root becomes a
conjunctive rule, a lasso logistic fit weighs the rules and drops most, and the rest is compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy, utf8
from .labelled import held_out, sample

_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_STOP, _PAUSE, _SHOUT = b".", b",;:", b"!?"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "lines_per_word", "upper", "digit", "stop", "pause", "shout",
    "symbol", "high", "distinct_words", "repeated_words", "distinct_lines",
)


#: Longer texts are counted in parts of about so many bytes.
PART_BYTES = 1 << 20
_SPACE, _LINE = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(rb"\n")


def _parts(text: bytes, border: re.Pattern) -> Iterator[bytes]:
    """``text`` cut before a border, about every PART_BYTES; a cut border goes with neither part."""
    at = 0
    while at <= len(text):
        found = border.search(text, at + PART_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end + 1


def _counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Numbers of words, their bytes, different ones, repetitions of the word before, lines, and different lines."""
    if len(text) <= PART_BYTES:
        words, lines = text.split(), text.split(b"\n")
        return len(words), sum(map(len, words)), len(set(words)), sum(map(eq, words, words[1:])), len(lines), len(set(lines))
    hashed = lambda parts: np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = size = repeated = n_lines = 0
    last, seen, seen_lines = [], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for part in _parts(text, _SPACE):
        words = part.split()
        n, size = n + len(words), size + sum(map(len, words))
        repeated += sum(map(eq, last + words, (last + words)[1:]))
        last, seen = words[-1:] or last, np.union1d(seen, hashed(words))
    for part in _parts(text, _LINE):
        lines = part.split(b"\n")
        n_lines, seen_lines = n_lines + len(lines), np.union1d(seen_lines, hashed(lines))
    return n, size, len(seen), repeated, n_lines, len(seen_lines)


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The numbers named in STATISTICS of one whole text; shares are by byte, or by word. An empty text has zeros."""
    n = max(len(text), 1)
    words, word_bytes, distinct, repeated, lines, distinct_lines = _counts(text)
    w = max(words, 1)
    share = lambda chars: 1 - len(text.translate(None, chars)) / n if text else 0.0
    return (
        float(np.log1p(len(text))), float(np.log1p(words)), word_bytes / w, lines / w, share(_UPPER), share(_DIGIT), share(_STOP), share(_PAUSE), share(_SHOUT),
        share(_SYMBOL), share(_HIGH), distinct / w, repeated / w, distinct_lines / lines,
    )


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (doc_id, y) and STATISTICS, for every row of ``docs``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text"), []
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                rows += [statistics_of(t) for t in utf8(texts.slice(low, high - low))]
            table = np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in table.T.copy())], names=[*keep, *STATISTICS])

    rows = docs.select(*(F.col(k).cast("long").alias(k) for k in keep), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join([f"{k} long" for k in keep] + [f"{s} double" for s in STATISTICS]))


#: A rule: (statistic's number, True for above / False for up to, bound), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as a Spark expression over the columns STATISTICS."""
        terms = [F.lit(self.bias)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for i, above, bound in rule:
                holds = holds & ((F.col(STATISTICS[i]) > bound) if above else (F.col(STATISTICS[i]) <= bound))
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs, so the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
        (logit,) = terms
        return 1 / (1 + F.exp(-logit))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3, leaf: int = 10, seed: int = 5) -> list[Rule]:
    """Paths of boosted trees: each tree splits the logistic residual of half the rows by squared error."""
    rng, n = np.random.default_rng(seed), len(x)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    coded = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T, strict=True)], axis=1)
    logit, rules = np.zeros(n), {}
    for _ in range(trees):
        probability = 1 / (1 + np.exp(-logit))
        residual, curve = y - probability, np.maximum(probability * (1 - probability), 1e-6)
        nodes: list[tuple[np.ndarray, Rule]] = [(rng.permutation(n)[: max(2 * leaf, n // 2)], ())]
        leaves: list[tuple[Rule, float]] = []
        while nodes:
            rows, path = nodes.pop()
            best = (1e-9, -1, 0)
            if len(path) < depth and len(rows) >= 2 * leaf:
                g, total = residual[rows], residual[rows].sum()
                for f in range(x.shape[1]):
                    if not len(bounds[f]):
                        continue
                    count = np.cumsum(np.bincount(coded[rows, f], minlength=len(bounds[f]) + 1))[:-1]
                    left = np.cumsum(np.bincount(coded[rows, f], weights=g, minlength=len(bounds[f]) + 1))[:-1]
                    right = len(rows) - count
                    fits = (count >= leaf) & (right >= leaf)
                    gain = np.where(fits, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(right, 1), 0) - total**2 / len(rows)
                    k = int(gain.argmax())
                    if fits[k] and gain[k] > best[0]:
                        best = (gain[k], f, k)
            _, f, k = best
            if f < 0:
                leaves.append((path, float(np.clip(residual[rows].sum() / (curve[rows].sum() + 1.0), -4, 4))))
                continue
            below = coded[rows, f] <= k
            for part, above in ((rows[below], False), (rows[~below], True)):
                longer = (*path, (f, above, float(bounds[f][k])))
                rules[tuple(sorted(longer))] = None
                nodes.append((part, longer))
        for path, value in leaves:
            logit += rate * value * holds(path, x)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for i, above, bound in rule:
        out &= (x[:, i] > bound) if above else (x[:, i] <= bound)
    return out


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the bias is not penalised."""
    n, k = z.shape
    z1 = np.hstack([z, np.ones((n, 1), dtype=z.dtype)])
    probe = np.ones(k + 1, dtype=z.dtype)
    for _ in range(20):
        probe = z1.T @ (z1 @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / float(np.linalg.norm(z1.T @ (z1 @ probe)))
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(rounds):
        gradient = z1.T @ (1 / (1 + np.exp(-(z1 @ v))) - y) / n
        new = v - step * gradient
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleModel:
    """The model for statistics ``x`` and labels ``y``. With fewer than 20 rows or two classes: the labels' share alone."""
    if len(y) < 20 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    weights, bias = fit_lasso(z, y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = 8000, negatives: int = 4000) -> RuleModel:
    """Fits on at most ``positives`` + ``negatives`` labelled rows, of which only the statistics reach the driver."""
    got = statistics(sample(docs, labels, "quality", positives, negatives), ("doc_id", "y")).toPandas().sort_values("doc_id")
    return fit(got[list(STATISTICS)].to_numpy(), got["y"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; score is the chance that quality is 1.

    Every whole text is scored by its statistics alone; a null text counts as empty. Rows that repeat a doc_id
    are scored one by one, a null doc_id is not held out, other columns are ignored, an empty table gives an
    empty result. With fewer than 20 labelled rows, or with rows of one class only, every score is the labels'
    share (0.5 without any).
    """
    model = train(docs, labels, **bounds)
    return score(docs, model, threshold)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    scored = statistics(docs).select("doc_id", held_out("doc_id").alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_rows(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``; repeated rows stay repeated."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("row").field("text"), []
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                found += [statistics_of(t) for t in utf8(texts.slice(low, high - low))]
            table = np.array(found, dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c) for c in table.T.copy())], names=["row", *STATISTICS])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in STATISTICS)])
    return rows.mapInArrow(run, schema).where(model.column() >= threshold).select("row.*")
