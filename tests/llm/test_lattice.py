import inspect
import itertools
import math
import random

import numpy as np
import pytest

from tidemark.llm import lattice
from tidemark.llm.common import table


def brute(rows):
    """Links of all pairs, with cosines by numpy in double precision."""
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i), d)
        out.append((d, links[i], c, d is None or c == d))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in lattice.near_duplicates(df, **options).collect()), key=str)


def test_matches_brute_force_on_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    print("links", sum(r[1] for r in want))
    assert run(df) == want


@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_groups_and_edge_rows(spark, cell_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 16))
    rows = [(int(i), (base[rng.integers(8)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).tolist()) for i in rng.permutation(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, [2 * x for x in rows[0][1]]), (5, rows[1][1]), (5, rows[2][1])]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0] * 15 + [None]), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [1e300, 2e300]), (None, rows[0][1]), (408, [float("inf")] * 16)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, rep string")
    got = run(df, cell_rows=cell_rows, tables=30)
    want = brute(rows)
    big = [w for w in want if w[0] != 407]  # the brute force overflows there
    assert [g for g in got if g[0] != 407] == [(d, n + (d in (405, 406)), c, k) for d, n, c, k in big]
    assert (407, 2, 405, False) in got
    assert run(df.limit(0)) == []


def test_decode_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    assert (np.abs(2 * p - np.rint(2 * p)) < 1e-9).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    for v in lattice.neighbours():
        assert (d <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


def pairs(dim, n=1500):
    """Vectors, and for each one at a cosine of 0.9."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(axis=1)[:, None] * a
    return a, 0.9 * a + math.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1)[:, None]


def defaults(n):
    spec = inspect.signature(lattice.near_duplicates).parameters
    blocks, tables = lattice.plan(n)
    return {"blocks": blocks, "tables": tables, "scale": spec["scale"].default, "probes": spec["probes"].default}


@pytest.mark.parametrize(("n", "dim"), [(1500, d) for d in (2, 8, 16, 32, 64, 128, 384, 768)] + [(5_000_000, d) for d in (2, 16, 64, 768)] + [(500_000_000, d) for d in (16, 64, 768)])
def test_recall_at_the_threshold(n, dim):
    """The defaults, and the plans for larger tables, find pairs of any length."""
    a, b = pairs(dim, 1500 if n < 1e8 else 500)
    x, y = (lattice.cell_keys(v, **defaults(n)) for v in (a, b))
    met = ((x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)).any(axis=1)
    near = np.bitwise_count((lattice.signatures(a) ^ lattice.signatures(b)).view(np.uint64)).sum(axis=1) <= lattice.most_differing(0.9)
    assert (met & near).mean() > 0.99


@pytest.mark.parametrize(("n", "most", "dim"), [(1500, 0.02, d) for d in (64, 128, 384, 768)] + [(5_000_000, 0.0008, 64), (5_000_000, 0.0008, 768), (500_000_000, 0.00005, 128)])
def test_few_unrelated_vectors_meet(n, most, dim):
    a, _ = pairs(dim, 700)
    keys = lattice.cell_keys(a, **defaults(n))
    met = np.zeros((350, 350), dtype=bool)
    for t in range(keys.shape[1]):
        for k in range(keys.shape[2]):
            met |= keys[:350, t, k][:, None] == keys[350:, t, 0][None, :]
    assert met.mean() < most


def test_signatures_leave_unrelated_vectors_out():
    a, _ = pairs(64, 1000)
    s = lattice.signatures(a).view(np.uint64)
    differ = np.bitwise_count(s[:500, None] ^ s[None, 500:]).sum(axis=2)
    assert (differ <= lattice.most_differing(0.9)).mean() < 1e-4


def test_defaults_on_short_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(size=8) * 0.2).tolist()) for i in range(120)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
