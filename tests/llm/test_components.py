import random

from vecspark.llm.components import components


def brute(edges):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def check(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == brute(edges)


def test_chain_hub_and_random(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000, 1001 + i) for i in range(300)]
    loose = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(200)]
    check(spark, chain + hub + loose)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, 1), (None, 2), (3, None), (-5, 7), (7, -5), (-5, 7)])
