import random

import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components


@pytest.mark.parametrize("hub_links", [1 << 16, 5])
def test_hubs_chains_and_edge_rows(spark, hub_links):
    rng = random.Random(4)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (60, 3), (None, 1), (2, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark), hub_links)
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in list(parent))
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []
