"""Connected components against union-find."""
import random

from textsieve.llm.graph import component_ids, components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_random_graphs_paths_and_stars(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    edges += [(5, 5), (None, 3), (7, None), edges[0], edges[0][::-1], (-4, 900), (900, -9)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == brute(edges)
    assert components(df.limit(0)).count() == 0


def test_component_ids(spark):
    rows = spark.createDataFrame([(0, 50), (1, 40), (2, 30), (3, 30), (4, None), (5, 7)], "row long, id long")
    links = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert {r.row: r.component_id for r in component_ids(rows, links).collect()} == {0: 30, 1: 30, 2: 30, 3: 30}
