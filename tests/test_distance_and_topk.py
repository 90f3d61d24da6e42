import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.errors import DocumentNotFound, InvalidParameter
from vecspark.functions import distance as dist
from vecspark.functions.filters import matches
from vecspark.operators import kmeans, topk
from vecspark.operators.index import hnsw, ivf, ivfpq

#: Fixed values.
PINS = [
    ("l2", [1, 2, 3], [1, 2, 3], 0), ("l2", [1, 2, 3], [4, 5, 6], 27), ("l2", [0, 0, 0], [0, 0, 0], 0),
    ("ip", [1, 2, 3], [1, 2, 3], -14), ("ip", [1, 2, 3], [4, 5, 6], -32), ("ip", [1, 0], [0, 1], 0),
    ("cos", [1, 2, 3], [1, 2, 3], 0), ("cos", [1, 0], [0, 1], 1), ("cos", [1, 1], [-1, -1], 2), ("cos", [0, 0], [1, 1], 1), ("cos", [1, 1], [0, 0], 1),
    ("hamming", [1, 2, 3], [1, 2, 3], 0), ("hamming", [1, 2, 3], [4, 5, 6], 3), ("hamming", [1, 2, 3], [1, 5, 3], 1), ("hamming", [0, 1, 0, 1], [1, 1, 0, 0], 2),
    ("unknown", [1, 2], [3, 4], 8), ("l2", [], [], 0), ("ip", [], [], 0), ("cos", [], [], 1), ("hamming", [], [], 0),
    ("l2", [5], [3], 4), ("ip", [5], [3], -15), ("hamming", [5], [3], 1), ("l2", [1] * 1000, [2] * 1000, 1000), ("ip", [1] * 1000, [2] * 1000, -2000), ("hamming", [1] * 1000, [2] * 1000, 1000),
]


def test_pins(spark):
    rows = [(i, [float(x) for x in a], [float(x) for x in b]) for i, (_, a, b, _) in enumerate(PINS)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    got = df.select("i", *[dist.distance(s, F.col("a"), F.col("b")).alias(s) for s in ("l2", "ip", "cos", "hamming", "unknown")]).collect()
    for r in got:
        assert r[PINS[r["i"]][0]] == pytest.approx(PINS[r["i"]][3], abs=1e-12), PINS[r["i"]][:3]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 8).flatmap(lambda n: st.tuples(*[st.lists(st.floats(-100, 100), min_size=n, max_size=n)] * 2)))
def test_numpy_twins(pair):
    a, b = np.array(pair[0]), np.array(pair[1])
    one = lambda s: float(dist.np_distance(s, a[None], b[None])[0, 0])
    assert one("l2") == pytest.approx(((a - b) ** 2).sum(), rel=1e-9, abs=1e-7)
    assert one("ip") == pytest.approx(-(a * b).sum(), rel=1e-9, abs=1e-7)
    assert one("hamming") == (a != b).sum()
    assert -1e-9 <= one("cos") <= 2 + 1e-9


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * 3
    return x, spark.createDataFrame([(i, [float(e) for e in v], i % 7) for i, v in enumerate(x.astype("f4"))], "id long, vector array<float>, label int")


def test_knn_bulk_and_plain_agree(spark, vectors):
    x, df = vectors
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    for space in ("l2", "ip", "cos", "hamming"):
        rows = lambda d: sorted(map(tuple, d.collect()))
        assert rows(topk.knn(q, df, 5, space)) == rows(topk.knn(q, df, 5, space, bulk=True))
    best = topk.nearest(df, [float(e) for e in x[7].astype("f4")], 3).collect()
    assert best[0]["id"] == 7 and best[0]["distance"] == 0
    assert topk.knn(q, df, 1000).count() == 6 * 300
    assert topk.knn(q, df.limit(0), 5).count() == 0 and topk.knn(q.limit(0), df, 5, bulk=True).count() == 0
    with pytest.raises(InvalidParameter):
        topk.knn(q, df, 0)


def test_large_query_side_is_not_broadcast(vectors, monkeypatch):
    _, df = vectors
    q = df.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    monkeypatch.setattr(topk, "small", lambda *a, **k: False)
    assert topk.knn(q.where("query_id < 3"), df, 2).count() == 6


def test_hydrate(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.7)], "query_id long, rank int, id string, distance double")
    docs = spark.createDataFrame([("a", 1)], "id string, v int")
    assert topk.hydrate(hits, docs).count() == 1
    with pytest.raises(Exception, match=DocumentNotFound.message):
        topk.hydrate(hits, docs, strict=True).collect()


def test_filters(spark):
    rows = ['{"tag":"test1","n":3,"b":true,"z":null,"a":[1,2]}', '{"tag":"other"}', None, "not json", '{"n":3.0}', '{"n":"3"}', '{"we ird":1}']
    df = spark.createDataFrame([(r,) for r in rows], "parameters string")
    n = lambda c: df.where(matches(c)).count()
    assert [n(c) for c in ({"tag": "test1"}, {"n": 3}, {"b": True}, {"z": None}, {"a": [1, 2]}, {"tag": "test1", "n": 3}, {"missing": 1}, {"n": "3"}, {"we ird": 1}, {})] == [1, 2, 1, 1, 1, 1, 0, 1, 1, 7]


def test_full_probe_is_exact_and_kmeans_agrees_with_plain(spark, vectors):
    x, df = vectors
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    centroids, lists = ivf.build(df, 6)
    assert np.array(centroids) == pytest.approx(kmeans.train_local(x.astype("f4").astype("f8"), 6), abs=1e-6)
    monkey = kmeans.LOCAL_BYTES
    try:
        kmeans.LOCAL_BYTES = 0
        assert np.array(kmeans.train(df, 6)) == pytest.approx(np.array(centroids), abs=1e-6)
    finally:
        kmeans.LOCAL_BYTES = monkey
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(ivf.search(q, lists, centroids, 6, 5)) == rows(topk.knn(q, df, 5))
    with pytest.raises(InvalidParameter):
        kmeans.train(df.limit(3), 6)


def test_product_quantization_is_lossless_on_few_rows(spark, vectors):
    """With no more residuals than codes each one is its own code, so table sums are exact distances."""
    _, df = vectors
    few = df.where("id < 200")
    q = few.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    centroids, books, encoded = ivfpq.build(few, 4, 4)
    got = {(r["query_id"], r["id"]): r["distance"] for r in ivfpq.search(q, encoded, centroids, books, 4, 5).collect()}
    want = {(r["query_id"], r["id"]): r["distance"] for r in topk.knn(q, few, 5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_graph_recall(spark, vectors):
    _, df = vectors
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    for space in ("l2", "ip"):
        graph = hnsw.build(df, 8, 64, space, shard_rows=120)
        got = {(r["query_id"], r["id"]) for r in hnsw.search(q, graph, 10, 100, space).collect()}
        want = {(r["query_id"], r["id"]) for r in topk.knn(q, df, 10, space).collect()}
        assert len(got & want) >= 0.9 * len(want)
