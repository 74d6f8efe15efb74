import numpy as np

import corpus_pipeline
from tests.llm import test_bpe, test_decontaminate, test_lines, test_shingles
from tidemark.llm import quality
from tidemark.llm.common import table


def brute_lines(docs):
    """Texts after line deduplication, by the pairwise definition restricted to lines of nearly equal length."""
    placed = sorted(((d, i), x) for d, t in docs for i, x in enumerate((t or "").encode().split(b"\n")) if x.strip())
    first, by_size = {}, {}
    for pos, x in placed:
        if x not in first:
            first[x] = pos
            by_size.setdefault(len(x), []).append(x)
    late = set()
    for n, own in by_size.items():
        if n < 24:
            continue
        for x in own:
            for y in by_size[n] + by_size.get(n - 1, []) + by_size.get(n + 1, []):
                if len(y) >= 24 and first[y] < first[x] and (x[: n // 3] == y[: n // 3] or x[-(n // 3) :] == y[-(n // 3) :]) and test_lines.distance(x, y) < 2:
                    late.add(x)
                    break
    out = []
    for d, t in docs:
        own = (t or "").encode().split(b"\n")
        kept = [x for i, x in enumerate(own) if not x.strip() or ((d, i) == first[x] and x not in late)]
        text = b"\n".join(kept).decode()
        if len(kept) == len(own) or text.strip():
            out.append((d, text))
    return out


def test_stages_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    stats = np.array([quality.statistics_of(t.encode()) for _, t in rows])
    logit = model.bias + sum((w * quality.holds(r, stats) for r, w in zip(model.rules, model.weights, strict=True)), np.zeros(len(rows)))
    rows = [r for r, z in zip(rows, 1 / (1 + np.exp(-logit)), strict=True) if z >= 0.3]
    rows = brute_lines(rows)
    kept = {d for d, c in test_shingles.brute(rows).items() if d == c}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    leaks = {r[0] for r in test_decontaminate.brute(rows, items) if r[3]}
    want = sorted((d, test_bpe.whole(t)[0]) for d, t in rows if d not in leaks)
    got = sorted((r.doc_id, np.array(r.ids, dtype="<u4").tobytes()) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    assert 0 < len(got) < docs.count()


def test_passages_of_one_item_go(spark):
    """A document with a passage of one benchmark item is dropped, whatever its doc_id; those with less than a window stay."""
    items = [r.text.split() for r in table(spark, "/root/testdata/sf0.001", "benchmark").orderBy("item_id").collect()]
    long = next(x for x in items if len(x) >= 10)
    passage, short = " ".join(long[:9]), " ".join(long[:7])
    rows = [(1, f"clean words before {passage} and after"), (2, f"clean words before {short} and other ones after"), (3, "nothing of it"), (None, f"no id {passage}"), (None, "no id, clean"), (4, passage.upper()), (5, None), (6, "")]
    rows += [(7, "the same id, clean"), (7, f"the same id {passage}")]
    docs = spark.createDataFrame([(d, t, i, "x", "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, id__ int, gone string, GONE_ string")
    got = corpus_pipeline.drop_leaks(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and sorted(r.id__ for r in got.collect()) == [1, 2, 4, 6, 7, 8]


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id__ int, place__ int, row string, whole long, gone string, node long, line int"
    more = (1, 2, "r", 4, "g", 6, 7)
    rows = [(1, None, "en", "s", 0, *more), (2, "", None, None, None, *more), (None, "a b c", "en", "s", 5, *more), (3, "x y\nx y", "en", "s", 7, *more), (3, "x y\nx y", "en", "s", 7, *more)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.schema.names == schema_names(schema)
            docs = spark.createDataFrame(docs.collect(), schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()


def test_repeated_lines_need_one_worker_a_task(spark):
    """The texts without their repeated lines are used twice, but made once; each making would hold a worker of its own."""
    docs = spark.createDataFrame([(1, "a b c\nd", 7), (2, "a b c\ne", 7), (3, "a b c", 5)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b c\nd", 7), (2, "e", 1)]


def schema_names(schema):
    return [x.split()[0] for x in schema.split(", ")]
