import hashlib
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import lines
from tidemark.llm.common import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, edits=1, least=24):
    key = lambda d: float("inf") if d is None else d
    placed = [((key(d), i), x) for d, t in docs if t is not None for i, x in enumerate(t.encode().split(b"\n")) if x.strip()]
    first = {}
    for pos, x in sorted(placed):
        first.setdefault(x, pos)
    late = {x for x in first for y in first if first[y] < first[x] and min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits}
    out = []
    for d, t in docs:
        own = [] if t is None else t.encode().split(b"\n")
        kept = [x for i, x in enumerate(own) if not x.strip() or ((key(d), i) == first[x] and x not in late)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in lines.digests(df).collect()), key=str)


def some_docs(seed, n=60):
    random.seed(seed)
    base = ["".join(random.choices("abé ", k=random.choice([3, 20, 23, 24, 25, 40]))) for _ in range(25)] + ["", "  "]

    def edited(x):
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            i = random.randint(0, len(x))
            x = random.choice([x[:i] + x[i + 1 :], x[:i] + random.choice("abé") + x[i:], x[:i] + random.choice("abé") + x[i + 1 :]])
        return x

    return [(random.randint(0, 40), "\n".join(edited(random.choice(base)) for _ in range(random.randint(0, 6)))) for _ in range(n)]


def test_small_texts_match_brute_force(spark):
    for seed in range(2):
        docs = some_docs(seed) + [(None, "a" * 30 + "\nnew"), (3, None), (4, ""), (41, "z" * 5000 + "\n" + "z" * 5001), (42, "z" * 4999)]
        docs += docs[:3]
        df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, line string, n_lines int, kept_text int")
        assert run(df) == brute(docs)
    assert run(df.limit(0)) == []


@pytest.mark.parametrize(("edits", "least"), [(0, 0), (1, 0), (2, 0), (2, 23), (3, 20)])
def test_other_bounds(spark, edits, least):
    docs = [(d, t.replace("b", "bb")[:200]) for d, t in some_docs(5, 40)] + [(50, "x\ny\nxy\n12\n\n13")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lines.dedup_lines(df, edits=edits, least_bytes=least, hot_lines=3)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()), key=str)
    assert got == brute(docs, edits, least)


def test_line_that_occurs_very_often(spark):
    docs = [(i, f"the same line in every document of all\nown {i}\n" + "short" * (i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lines.dedup_lines(df, hot_lines=10)
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(i, 0 if i == 0 else 1 + (i % 3 == 0)) for i in range(300)]


def test_very_long_texts(spark):
    """A text of 400,000 lines, and two lines of a million bytes that differ in one."""
    many = "\n".join(f"line number {i % 300_000}" for i in range(400_000))
    long = "".join(random.Random(1).choices("abcdefgh ", k=1_000_000))
    df = spark.createDataFrame([(1, many), (2, long), (3, long[:500_000] + "X" + long[500_001:]), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, len(r.kept_text)) for r in lines.dedup_lines(df, least_bytes=1000).collect()}
    assert got == {1: (100_000, len("\n".join(f"line number {i}" for i in range(300_000)))), 2: (0, 1_000_000), 3: (1, 0), 4: (0, 5)}


def test_oracle(spark):
    got = run(table(spark, "/root/testdata/sf0.01", "documents"))
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted((tuple(r) for r in con.execute(lines.ORACLE).fetchall()), key=str)
    assert sum(r[2] for r in got) > 0


def test_edits_and_keys():
    random.seed(4)
    for _ in range(3000):
        a, b = (bytes(random.choices(b"ab", k=random.randint(0, 9))) for _ in "ab")
        for k in (2, 3):
            assert lines.within_edits(a, b, k) == (distance(a, b) <= k)
            if distance(a, b) <= k:
                assert set(lines.piece_keys(a, k)) & set(lines.piece_keys(b, k))
                assert {x for p in lines.all_deletion_keys(a, k) for x in p} & {x for p in lines.all_deletion_keys(b, k) for x in p}
        a = bytes(random.choices(b"ab", k=random.randint(0, 7)))
        b = bytes(random.choices(b"ab", k=random.randint(0, 7)))
        assert lines.within_one_edit(a, b) == (distance(a, b) < 2)
        if a and b and distance(a, b) == 1:
            assert set(lines.half_keys(a)) & set(lines.half_keys(b))
        keys = {}
        for x in (a, b):
            k = lines.deletion_keys(x) if x else np.zeros(1)
            for i in range(len(x)):
                assert keys.setdefault(x[:i] + x[i + 1 :], k[i]) == k[i]
            if x:
                assert keys.setdefault(x, k[-1]) == k[-1]
        assert len(set(keys.values())) == len(keys)
