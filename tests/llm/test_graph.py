import random

import pytest

from keelson.llm import graph


def brute(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    r = random.Random(4)
    edges = [(r.randint(-500, 500), r.randint(-500, 500)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2090)] + [(7, 7), (None, 3), (5, None)] + edges[:20]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == brute(edges)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
