import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate as dc
from tidemark.llm.common import batches_of, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 7)):
                windows.setdefault(tuple(w[i : i + 8]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def run(docs, items, **options):
    return sorted((tuple(r)[:6] for r in dc.decontaminate(docs, items, **options).collect()), key=str)


def test_matches_brute_force_on_documents(spark):
    docs, items = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(r[2] > 0 for r in want) >= 3
    assert run(docs, items) == want


def test_edge_rows_and_blocks(spark):
    random.seed(2)
    vocabulary = ["a", "b", "Ça", "d1"]
    docs = [(i % 40, " ".join(random.choices(vocabulary, k=random.randint(0, 120)))) for i in range(80)]
    docs += [(None, "a b a b a b a b a"), (1, None), (1, ""), (2, "x" * 100_000 + " a" * 50_000)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 3, 8, 9, 12])))) for i in range(30)]
    items += [(None, "a"), (3, None), (4, "--"), (5, items[0][1]), (10, "d1 d1"), (10, "d1 d1")]
    d = spark.createDataFrame([(*x, 0, "y") for x in docs], "doc_id long, text string, n_hit int, segment string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert run(d, b) == brute(docs, items)
    assert run(d, b, block_bytes=60) == brute(docs, items)
    assert run(d.limit(0), b) == []
    assert run(d, b.limit(0)) == brute(docs, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y y three"), (2, "three two one"), (3, "one two three")], "doc_id long, text string")
    index = dc.build_index(docs)
    near = lambda slop: sorted((r.doc_id, r.first, r.last) for r in dc.search(index, [(9, b"one two three")], slop=slop).collect())
    assert near(0) == [(3, 0, 2)] == near(2)
    assert near(3) == [(1, 0, 5), (3, 0, 2)]
    assert [list(map(int, x)) for x in dc.intersect([np.array([0, 4, 9]), np.array([1, 5])])] == [[0, 4], [1, 5]]


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Both scans hand the workers batches of a bounded size, and the session's own bound holds again afterwards."""
    key, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", [], dc.Scratch.save
    before = spark.conf.get(key)

    def spy(self, df, path=None):
        seen.append(int(spark.conf.get(key)))
        return save(self, df, path)

    monkeypatch.setattr(dc.Scratch, "save", spy)
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 5000) for i in range(400)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = dc.decontaminate(docs, items).collect()
    assert len(got) == 400 and all(r.n_hit == 40_000 and r.n_items == 1 for r in got)
    assert seen == [dc.BATCH_BYTES] * 2 and spark.conf.get(key) == before

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes])})

    with batches_of(spark, dc.BATCH_BYTES):
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * dc.BATCH_BYTES


def test_matches_are_merged_where_they_are_found(spark, monkeypatch):
    """A task of either scan has one Python step, as each step holds a worker; matches beyond one part of MERGED_ROWS count too."""
    plans, save = [], dc.Scratch.save

    def spy(self, df, path=None):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return save(self, df, path)

    monkeypatch.setattr(dc.Scratch, "save", spy)
    docs = [(i, "a b c d e f g h " * 1000 + "x") for i in range(4)]
    items = [(1, "a b c d e f g h"), (2, "b c d e f g h a b c"), (3, "x y")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    assert run(d, b) == brute(docs, items)
    assert plans == [1, 1]
