import numpy as np

from tidemark.llm import toxicity as tox
from tidemark.llm.common import table


def test_gradients_match_differences():
    network = tox.Network.new([b"ab", b"cde"], seed=1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words = [b"ab", b"cde", b"xyz", b"q"]
    rng = np.random.default_rng(0)
    index, mask = rng.integers(0, 4, (6, 5)), (np.arange(6)[:, None] < np.array([6, 3, 1, 6, 4])).astype(float)
    target = rng.normal(size=5)

    def loss():
        return float((network.forward(network.inputs(words)[0], index, mask)[0] * target).sum())

    x = network.inputs(words)[0]
    _, kept = network.forward(x, index, mask, keep=True)
    g, dx = network.backward(x, index, mask, kept, target)
    for name in g:
        flat = network.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[name].reshape(-1)[i]) < 2e-3, name
    old = network.p["words"][0, 2]
    network.p["words"][0, 2] = old + 1e-4
    up = loss()
    network.p["words"][0, 2] = old - 1e-4
    assert abs((up - loss()) / 2e-4 - dx[0, 2]) < 2e-3


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        _, first, size = tox.windows_of([5, n])
        covered = {k for f, s in zip(first, size, strict=True) for k in range(f, f + s)}
        assert covered == set(range(5 + n))


def test_trigrams_of_a_word_do_not_depend_on_its_neighbours():
    grams, first = tox.trigrams([b"abc", b"x", "é".encode()])
    parts = np.split(grams, first[1:])
    for word, got in zip([b"abc", b"x", "é".encode()], parts, strict=True):
        assert got.tolist() == tox.trigrams([word])[0].tolist()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = tox.classify(docs, labels)
    assert scored.count() == docs.count()
    got = scored.where("held_out").join(labels, "doc_id").where("toxic is not null").toPandas()
    caught = ((got.predicted == 1) & (got.toxic == 1)).sum() / (got.toxic == 1).sum()
    print(len(got), (got.predicted == got.toxic).mean(), caught)
    assert (got.predicted == got.toxic).mean() > 0.96 and caught > 0.8


def test_edge_rows(spark):
    texts = [b"you vile fool " * 3 + b"a b c d", b"a nice day in the park"] * 40
    network = tox.fit(texts, np.array([1, 0] * 40), updates=60)
    rows = [(1, None), (1, ""), (None, "you vile fool"), (3, "a nice day"), (3, "a nice day"), (4, "day " * 30_000 + "vile"), (5, "?!")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, score string, held_out int")
    got = tox.score(df, network).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[None], by[3], by[1], by[5]) == (1, 0, 0, 0)
    assert tox.score(df.limit(0), network).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in tox.classify(df.where("doc_id = 3"), none).collect()} == {0.01}


def plain_logit(network, words):
    """The logit of one window, step by step and number by number."""
    p, h = network.p, tox.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    xs = []
    for w in words:
        grams = tox.trigrams([w])[0]
        xs.append(np.r_[p["words"][network.vocabulary.get(w, len(network.vocabulary))], np.mean([p["chars"][g] for g in grams], axis=0)].astype(np.float64))
    sides = {}
    for side, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
        state, out = np.zeros(h), {}
        for t in order:
            a = xs[t] @ p[f"x{side}"] + p[f"c{side}"]
            u = state @ p[f"u{side}"]
            z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h:])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + (r * state) @ p[f"n{side}"])
            out[t] = state
        sides[side] = out
    both = [np.r_[sides["f"][t], sides["b"][t]] for t in range(len(xs))]
    weight = np.exp([b @ p["attend"] for b in both])
    return float((weight / weight.sum()) @ np.array(both) @ p["out"] + p["bias"][0])


def plain_score(network, text):
    words = "".join(chr(b) if b >= 128 else chr(b).lower() if chr(b).isalpha() else " " for b in text).encode("latin-1").split()
    if not words:
        return 0.0
    logits, at = [], 0
    while True:
        logits.append(plain_logit(network, words[at : at + tox.WINDOW]))
        if at + tox.WINDOW >= len(words):
            return float(1 / (1 + np.exp(-(max(logits) + network.shift))))
        at += tox.STRIDE


def random_texts(n):
    rng = np.random.default_rng(8)
    known = [b"vile", b"Fool", b"day", b"park", "más".encode(), b"x"]
    return [b" ".join(rng.choice(known) if rng.random() < 0.7 else bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 130))) for _ in range(n)] + [b"", b"?? 12"]


def test_scores_match_a_plain_loop(monkeypatch):
    network = tox.Network.new([b"vile", b"fool", b"day"], seed=2)
    network.shift = 0.3
    texts = random_texts(30)
    want = [plain_score(network, t) for t in texts]
    assert np.allclose(tox.scores(network, texts), want, atol=1e-5)
    for size in (1, 40, 200):  # the way of texts and words too long to be held
        monkeypatch.setattr(tox, "PART_BYTES", size)
        assert np.allclose(tox.scores(network, texts), want, atol=1e-5)


def test_fit_separates_and_learns_from_long_texts(spark):
    rng = np.random.default_rng(5)
    mild = ["a", "nice", "day", "in", "the", "green", "park", "we", "walk"]
    text = lambda n, bad: " ".join(rng.choice(mild, n).tolist() + ["you", "vile", "fool"] * bad + rng.choice(mild, n).tolist())
    rows = [(i, text(1500, 3 if i % 2 else 0), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = tox.classify(docs, labels, most_chars=16_000, updates=80).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95


def test_excerpts_are_spread(spark):
    from pyspark.sql import functions as F
    from tidemark.llm.labelled import excerpt

    rows = [("x" * 50,), ("".join(chr(97 + i // 100) for i in range(2600)),), (None,), ("é" * 101,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(excerpt(F.col("text"), 80)).collect()]
    assert got[0] == "x" * 50 and got[2] is None and len(got[3]) == 87
    assert got[1][:10] == "a" * 10 and got[1][-10:] == "z" * 10 and [p[0] for p in got[1].split()] == list("adhloswz")
