"""Blocked scans against folds of every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import queries as core
from vecspark.operators import scan, topk

#: Queries whose pairs meet in blocks and not as rows of a join.
BLOCKED = ["knn_cos", "knn_postfilter_overfetch", "search_documents_hydrated", "knn_l2", "search_vectors_projection", "hnsw_exact_contract", "engine_delete_compact_search", "engine_flat_search", "knn_ip", "knn_distinct_doc", "range_search_l2", "knn_hamming", "lsh_search", "distance_stats", "ip_hnsw_offset", "recall_at_10_ivf", "ivf_trained_search", "ivf_full_probe_equals_flat", "ivfpq_trained_search", "ivfpq_rerank_search"]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BLOCKED)
def test_pairs_meet_in_blocks(spark, sf_dir, name):
    assert "MapInArrow" in plan(core.QUERIES[name](spark, sf_dir))


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeated rows, nulls, other lengths, zeros, NaN and infinite, tiny and huge components, ids as text or not there."""
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    x = [[float(e) for e in v] for v in np.round(rng.normal(size=(400, 5)), 1)]
    x += x[:40] + [[1.0] * 5] * 60 + [[0.0] * 5, None, [], [1.0], [1.0] * 6, [None, 1.0, 1.0, 1.0, 1.0], [nan, 1.0, 0.0, 0.0, 0.0], [inf, 1.0, 0.0, 0.0, 0.0], [1e-30] * 5, [3e38] * 5, [-0.0] * 5]
    data = [(None if i == 17 else f"d{i * 7 % 1000}", v, None if i % 50 == 3 else i % 6) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id string, vector array<float>, doc int").repartition(5).persist()
    q = df.where("id in ('d0', 'd7', 'd14', 'd70') or abs(get(vector, 0)) > 2.2 or get(vector, 0) = 1 or get(vector, 0) is null or size(vector) <> 5").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    return q.persist(), df


@pytest.mark.parametrize("space", ["l2", "ip", "cos", "hamming"])
def test_blocks_equal_folds(odd, space, monkeypatch):
    q, df = odd
    monkeypatch.setattr(scan, "QUERY_BYTES", 2500)  # several parts of queries
    usual = q.where(scan.dense("qvec", 5))
    d = topk.pairs(usual, df, space, ("doc",))
    assert rows(topk.candidates(usual, df, scan.Task(space))) == rows(d.select("query_id", "id", "distance"))
    distinct = usual.where("query_id is not null")
    once = df.where("id is not null")
    pairs = topk.pairs(distinct, once, space, ("doc",)).persist()
    assert rows(topk.knn(distinct, once, 4, space)) == rows(topk.ranked(pairs, 4))
    assert rows(topk.within(distinct, once, 2.5, space)) == rows(topk.ranked(pairs.where("distance <= 2.5"), 1000))
    assert rows(topk.within(distinct, once, 2.5, space, 3)) == rows(topk.ranked(pairs.where("distance <= 2.5"), 3))
    best = pairs.groupBy("query_id", "doc").agg(F.min("distance").alias("distance"))
    assert rows(topk.knn_documents(distinct, once, 3, space)) == rows(topk.ranked(best, 3, "doc"))


def test_odd_queries_are_folded(odd):
    q, df = odd
    for space in ("l2", "cos"):
        assert rows(topk.candidates(q, df, scan.Task(space))) == rows(topk.pairs(q, df, space).select("query_id", "id", "distance"))


def test_lsh_equals_the_join_on_buckets(odd):
    """No two rows are joined on a bucket any more; the results are those of the library's join."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from vecspark.operators.index import lsh

    whole = "size(vector) = 5 and forall(vector, x -> x is not null) and id is not null"
    q, df = odd[0].where(whole.replace("vector", "qvec").replace("id is", "query_id is")).persist(), odd[1].where(whole).persist()
    side = lambda d, i, v: d.select(F.col(i).alias("key"), array_to_vector(F.col(v).cast("array<double>")).alias("features"))
    c, asked = side(df, "id", "vector"), side(q, "query_id", "qvec")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.5, numHashTables=8, seed=7).fit(c)
    hits = model.approxSimilarityJoin(asked, c, 1.5, "d").select(F.col("datasetA.key").alias("query_id"), F.col("datasetB.key").alias("id"), (F.col("d") * F.col("d")).alias("distance"))
    found = lsh.search(q, df, 6, radius=1.5)
    assert "MapInArrow" in plan(found) and "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found).replace("Union", "")
    assert rows(found) == rows(topk.ranked(hits, 6))


def test_statistics_equal_folds(odd):
    from vecspark.functions import distance as dist

    q, df = odd[0].where("size(qvec) = 5 and not exists(qvec, x -> isnan(x) or abs(x) > 1e30) or qvec is null"), odd[1].where("not exists(vector, x -> isnan(x) or abs(x) > 1e30)")
    spaces = ["l2", "ip", "cos", "hamming"]
    fold = lambda q, c: c.crossJoin(q).select("doc", F.explode(F.create_map(*[e for s in spaces for e in (F.lit(s), dist.distance(s, F.col("qvec"), F.col("vector")))])).alias("space", "distance"))
    want = {(r["doc"], r["space"]): r for r in fold(q, df).groupBy("doc", "space").agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.avg("distance").alias("mean")).collect()}
    got = scan.statistics(q, df, "doc", spaces, fold).groupBy("doc", "space").agg(F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("total") / F.sum("n")).alias("mean")).collect()
    assert len(got) == len(want) == 7 * 4
    for r in got:
        w = want[r["doc"], r["space"]]
        assert (r["least"], r["most"]) == (w["least"], w["most"]) and r["mean"] == pytest.approx(w["mean"], rel=1e-9, abs=1e-9)


def test_every_pair_with_an_offset(odd):
    from vecspark.functions import distance as dist

    q, df = odd
    fold = lambda q, c: c.crossJoin(q).select("query_id", "id", dist.ip_hnsw(F.col("qvec"), F.col("vector")).alias("distance"))
    assert rows(scan.every(q, df, 1.0, fold)) == rows(fold(q, df))


def test_cells_equal_folds(odd):
    """Assigned centroids are the folds' nearest, the least of equals, and rows travel in batches."""
    from vecspark.operators import kmeans

    df = odd[1]
    centroids = [[0.0] * 5, [1.0] * 5, [0.1, -0.2, 0.3, 0.0, 1.0], [1.0] * 5, [-1.0, 0.5, 0.0, 2.0, 0.0]]
    got = kmeans.assign(df, centroids)
    assert "ArrowEvalPython" in plan(got)
    usual = "size(vector) = 5 or size(vector) = 6 or vector is null"
    folded = df.where(usual).withColumn("cid", kmeans.closest(F.col("vector"), kmeans.literal(centroids)))
    assert rows(got.where(usual)) == rows(folded)
