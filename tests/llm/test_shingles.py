import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import shingles, simhash
from tidemark.llm.common import Scratch, table


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components by all pairs; rows that share a doc_id are one document."""
    rows = [(d, grams(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x == y or len(x & y) / len(x | y) >= 0.8:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: find(d) for d in parent}


def copies(seed, pairs, rate, n=300):
    """Pairs of random texts, the second with this share of its words changed, kept at a similarity of 0.8 or more."""
    rng, rows = random.Random(seed), []
    while len(rows) < 2 * pairs:
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        other = [f"x{rng.randrange(50_000)}" if rng.random() < rate else w for w in words]
        x, y = grams(" ".join(words)), grams(" ".join(other))
        if len(x & y) / len(x | y) >= 0.8:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("rate", [0.005, 0.01, 0.02])
def test_stage_drops_near_copies(spark, rate):
    rows = copies(1, 60, rate)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and len(set(want.values())) < len(want) - 1


@pytest.mark.parametrize("most", [300, 1 << 21])
def test_chains_and_split_groups(spark, most):
    """Versions of one text, of which many are below the similarity to each other, in one cell and in many."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            words[rng.randrange(120)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=120, rows=3, cell_shingles=most)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert 1 < len(set(want.values())) < 60


def test_nulls_short_texts_and_repeated_ids(spark):
    rows = [(3, None), (2, " \n"), (7, "One Two"), (5, "one\ttwo"), (5, "a b c d e f"), (8, "A b c d e f"), (None, "one two"), (9, "two one"), (10, "w " * 9), (11, "w " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(((r.doc_id, r.component_id) for r in shingles.near_duplicates(df).collect()), key=str) == sorted(((d, want.get(d)) for d, _ in rows), key=str)
    assert shingles.near_duplicates(df.limit(0)).collect() == []


def test_recall_of_bands():
    """Pairs at a similarity just above 0.8 share a key, as often as the docstring says."""
    rng, missed = np.random.default_rng(5), 0
    for _ in range(1500):
        x = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        a, b = np.sort(x[:405]), np.sort(x[45:])
        missed += not (shingles.band_keys(a, 30, 6) == shingles.band_keys(b, 30, 6)).any()
    assert missed <= 3


def test_equal_texts_of_many_documents(spark):
    rows = [(i, f"one text in {'many'} documents, all of them equal") for i in range(60)] + [(i, f"another text {i} that is by itself in this table") for i in range(60, 70)]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=3).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(60)] + [(i, i) for i in range(60, 70)]


def test_simhash_finds_candidates(spark):
    """Without MinHash bands, sets whose SimHashes differ in up to the radius are candidates, equal SimHashes too."""
    rows = [(d + 200 * i, t) for i, rate in enumerate((0.005, 0.01, 0.02)) for d, t in copies(i + 2, 40, rate)]
    rows += [(1000, "a b c d e f"), (1001, "a b c d e f a b c d e f a b"), (1002, None), (1003, "")]
    prints = {d: shingles.of_hashes(shingles.shingle_set((t or "").encode())) for d, t in rows}
    near = {d + 1 for d in prints if d < 1000 and d % 2 == 0 and (prints[d] ^ prints[d + 1]).bit_count() <= 7}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in shingles.near_duplicates(docs, bands=0).collect() if r.component_id != r.doc_id}
    assert got - {1003} == near and 60 < len(near) < 120
    near -= {d for d in near if prints[d] == prints[d - 1]}
    for parts in (3, 4, 6, 8):
        a = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, d) for x, d in {x: d for d, x in reversed(prints.items()) if d < 1000}.items()], "fp long, rep long")
        links = {tuple(sorted((r.a, r.b))) for r in simhash.close_links(a, Scratch(spark), 7, parts).collect()}
        assert links == {(d - 1, d) for d in near}
