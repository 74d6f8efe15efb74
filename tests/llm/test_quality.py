import math
import zlib

import numpy as np

from tidemark.llm import quality
from tidemark.llm.common import table


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("quality is not null").toPandas()
    assert docs.count() == quality.classify(docs, labels).count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    h = got[got.held_out]
    print(len(quality.train(docs, labels).rules), len(h), auc(h.quality.to_numpy(), h.score.to_numpy()), (h.predicted == h.quality).mean())
    assert auc(h.quality.to_numpy(), h.score.to_numpy()) > 0.97
    assert (h.predicted == h.quality).mean() > 0.95


def test_column_equals_the_rules():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] <= 0.5) | (x[:, 5] > 1)).astype(float)
    model = quality.fit(x, y)
    logit = model.bias + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((logit > 0) == y).mean() > 0.95
    assert all(0 < len(r) <= 3 for r in model.rules)


def test_scores_follow_the_model(spark):
    x, y = np.random.default_rng(0).normal(size=(400, len(quality.STATISTICS))), np.arange(400) % 2
    x[:, 4] += y
    model = quality.fit(x, y.astype(float))
    rows = [(1, "HELLO a"), (2, None), (2, ""), (None, "a b\n" * 1000), (3, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "doc_id long, text string, score double, y int")
    got = quality.score(df, model).collect()
    stats = np.array([quality.statistics_of((t or "").encode()) for _, t in rows])
    logit = model.bias + sum(w * quality.holds(r, stats) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(sorted(r.score for r in got), sorted(1 / (1 + np.exp(-logit))))
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert [round(r.score, 6) for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    assert quality.classify(docs.limit(0), none).collect() == []


def plain_statistics(text):
    """The statistics counted byte by byte."""
    n, words, word = len(text), [], bytearray()
    for b in text + b" ":
        if b in b" \t\n\r\v\f":
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    lines, line = [], bytearray()
    for b in text:
        if b == 10:
            lines.append(bytes(line))
            line = bytearray()
        else:
            line.append(b)
    lines.append(bytes(line))
    share = lambda test: sum(1 for b in text if test(b)) / n if n else 0.0
    w = max(len(words), 1)
    repeated = sum(1 for i in range(1, len(words)) if words[i] == words[i - 1])
    return (
        math.log(1 + n), math.log(1 + len(words)), sum(len(x) for x in words) / w, len(lines) / w, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b == 46),
        share(lambda b: b in b",;:"), share(lambda b: b in b"!?"), share(lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~"), share(lambda b: b >= 128), len(set(words)) / w, repeated / w, len(set(lines)) / len(lines),
    )


def test_statistics_match_a_plain_count(spark):
    texts = ["", " \n ", "Hello, World! a a a.\nx = {y} 12\n\nx = {y} 12", "é ñ ü\x0b?", "same same\n" * 50]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()]
    for t in texts:
        assert np.allclose(quality.statistics_of(t.encode()), plain_statistics(t.encode()))


def test_long_texts_are_counted_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"", b"\n", b" \n\n ", b"a a a\na a", b"x" * 90] + [b"".join(rng.choice([b"ab ", b"ab\n", b"c", b"\n", b"\t", b"Long-word"], 60).tolist()) for _ in range(40)]
    want = [quality.statistics_of(t) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(quality, "PART_BYTES", size)
        assert [quality.statistics_of(t) for t in texts] == want


def test_lasso_weights_are_optimal():
    """At the optimum the gradient is the penalty, against the sign, where a weight is not zero, and no larger elsewhere."""
    rng = np.random.default_rng(6)
    z = (rng.random((2000, 30)) < 0.4).astype(np.float64)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + z[:, 2] - 0.5)))).astype(float)
    penalty = 5e-3
    w, bias = quality.fit_lasso(z, y, penalty, rounds=3000)
    gradient = z.T @ (1 / (1 + np.exp(-(z @ w + bias))) - y) / len(y)
    used = np.abs(w) > 1e-6
    assert 3 <= used.sum() < 30
    assert np.allclose(gradient[used], -penalty * np.sign(w[used]), atol=1e-5) and (np.abs(gradient[~used]) <= penalty + 1e-5).all()
    assert abs((1 / (1 + np.exp(-(z @ w + bias))) - y).mean()) < 1e-5


def test_few_labels_give_their_share(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(1, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(1, 12)], "doc_id long, quality int")
    learnt = [i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 5]
    assert {round(r.score, 6) for r in quality.classify(docs, labels).collect()} == {round(sum(i < 4 for i in learnt) / len(learnt), 6)}
