import itertools
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, component_id string, fp int"


def brute(rows):
    prints = []
    for doc, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ")
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in words).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    parent = {d: d for d, _ in prints if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([p for p in prints if p[0] is not None], 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted(((d, f"{x:016x}", None if d is None else find(d)) for d, x in prints), key=str)


def run(df, **options):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **options).collect()), key=str)


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("parts", [2, 3, 4, 6])
def test_links_of_planted_fingerprints(spark, parts):
    """Texts with many close fingerprints, for every number of partitions."""
    random.seed(parts)
    base = [random.choice("ab cd ef gh ij kl mn".split()) for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            words[random.randrange(400)] = random.choice("xyz")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert run(df, parts=parts, cell_rows=20) == brute(rows)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(3, None), (2, ""), (7, "One Two"), (5, "one\ttwo"), (5, "one two"), (None, "one two"), (9, "w " * 150_000)]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_thresholds_sum_and_are_cheapest():
    rng = np.random.default_rng(1)
    costs = np.sort(rng.integers(0, 50, (20, 4, 4)), axis=2).astype(float)
    got = simhash.allocate(costs, 0)
    for q in range(20):
        assert got[q].sum() == 0
        best = min(sum(costs[q, p, t[p] + 1] for p in range(4)) for t in itertools.product(range(-1, 3), repeat=4) if sum(t) == 0)
        assert sum(costs[q, p, got[q, p] + 1] for p in range(4)) == best
