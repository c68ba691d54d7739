"""Connected components by contraction against union-find."""

import random

import pytest

from deliverix.llm.components import connected_components, star_edges


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    least = {}
    for x in parent:
        least[root(x)] = min(x, least.get(root(x), x))
    return sorted((x, least[root(x)]) for x in parent)


GRAPHS = {
    "chain": [(i, i + 1) for i in range(400)],
    "shuffled chain": list(zip(p := random.Random(1).sample(range(300), 300), p[1:])),
    "star": [(0, i) for i in range(1, 200)],
    "star of a large centre": [(999, i) for i in range(200)],
    "cycle, repeats and both ways": [(1, 2), (2, 1), (2, 3), (3, 1), (3, 1), (7, 8)],
    "random": [(random.Random(k).randint(0, 500), random.Random(k + 7).randint(0, 500)) for k in range(300)],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_components(spark, name):
    edges = [(u, v) for u, v in GRAPHS[name] if u != v]
    df = spark.createDataFrame(edges, "u long, v long")
    assert sorted(map(tuple, connected_components(df).collect())) == brute(edges)


def test_no_edges_and_loops(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert connected_components(spark.createDataFrame([(4, 4)], "u long, v long")).collect() == []


def test_star_edges_connect_what_shares_a_hub(spark):
    rng = random.Random(3)
    members = [(n, h) for n in range(200) for h in {rng.randint(0, n // 3) for _ in range(4)}]
    members += [(h, h) for h in {h for _, h in members}]  # a hub is a member of its own buckets
    df = spark.createDataFrame(members, "node long, hub long")
    edges = sorted(map(tuple, star_edges(df, "node", "hub").collect()))
    assert len(edges) == len(set(edges)) < len(members)
    assert brute(edges) == brute([m for m in members if m[0] != m[1]])
