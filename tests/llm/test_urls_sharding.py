import random
import re
import zlib

import pytest

from tidemark.llm import sharding, urls
from tidemark.llm.common import table


def test_globs_match_regular_expressions():
    random.seed(1)
    globs = ["".join(random.choices(["a", "b", "/", ".", "*", "**"], k=random.randint(0, 9))) for _ in range(150)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(random.choices("ab/.", k=random.randint(0, 12))) for _ in range(300)]
    got = urls.fits(urls.compile_globs([g.encode() for g in globs]), [t.encode() for t in texts])
    for j, g in enumerate(globs):
        rule = re.compile("".join({"*": "[^/]*", "**": ".*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g)))
        assert [bool(rule.fullmatch(t)) for t in texts] == got[:, j].tolist(), g


def judged(url):
    _, mark, rest = (url or "").partition("://")
    rest = re.split("[?#]", rest, maxsplit=1)[0] if mark else ""
    host, slash, path = rest.partition("/")
    host, path = host.translate({c: c + 32 for c in range(65, 91)}), slash + path
    fit = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    v, rule = max(fit, key=lambda x: len(x[1]), default=("allow", None))
    return host, path, rule, v


def test_judge(spark):
    rows = [(r.page_id, r.url) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    rows += [(None, "http://a.NET/X"), (1, None), (2, ""), (3, "x.net/"), (4, "http://a.net"), (5, "http://foo/bar.net/x"), (6, "http://example.net/en/?q"), (7, "HTTP://A.Example.Com/de/#x")]
    rows += [(8, "http://xnet/"), (9, "http://é.org/fr/" + "é" * 5000), (9, "http://a.org/fr/"), (9, "http://a.org/fr/")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = sorted((tuple(r) for r in urls.judge(df).collect()), key=str)
    assert got == sorted(((p, *judged(u)) for p, u in rows), key=str)
    assert urls.judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("case", ["documents", "edges"])
def test_shards(spark, case):
    if case == "documents":
        df = table(spark, "/root/testdata/sf0.01", "documents")
    else:
        rows = [(i % 50, None if i % 7 == 0 else "é" * (i % 90)) for i in range(900)] + [(5, "same")] * 500 + [(None, "x")] * 3
        df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, size int, shard string")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sharding.byte_shards(df).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((g.doc_id, g.size, g.text_crc32) for g in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert {(g.law, g.grown_shard) for g in got} == {("bytes", None)}
    total, most = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    by = {s: sorted((g.slot, g.doc_id if g.doc_id is not None else -1, g.size) for g in got if g.shard == s) for s in range(24)}
    for s, own in by.items():
        assert [x[0] for x in own] == list(range(len(own)))
        assert abs(sum(x[2] for x in own) - total / 24) <= most, s
    ids = [x[1] for s in range(24) for x in by[s]]
    assert ids == sorted(ids)
    assert sharding.byte_shards(df.limit(0)).collect() == []
