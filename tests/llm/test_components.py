import random

import pytest

from pipewright.llm.components import components


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_random_graphs_and_chains(spark, limit):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 400)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
