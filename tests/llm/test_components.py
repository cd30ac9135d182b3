import random

from textloom.llm.components import connected_components


def test_random_graphs_and_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(220)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
