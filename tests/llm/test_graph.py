import random

import pytest

from docloom.llm import graph


@pytest.mark.parametrize("limit", [0, 100_000])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "ONE_TASK", limit)
    pick = random.Random(3)
    edges = [(pick.randrange(-200, 200), pick.randrange(-200, 200)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] * 2
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted((x, top(x)) for x in parent)
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
