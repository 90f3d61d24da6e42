"""Inverted lists: each row belongs to its nearest centroid, a query looks at its nprobe nearest lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.distance import distance, name
from ...operators import kmeans, scan
from ...operators.topk import candidates, ranked


def centroid_frame(like: DataFrame, centroids: list[list[float]]) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return like.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")


def probes(queries: DataFrame, centroids: list[list[float]], nprobe: int, space: str = "l2") -> DataFrame:
    """``query_id, qvec, cid``: the nprobe nearest lists of each query, ties to the least list."""
    near = queries.select("query_id", "qvec").crossJoin(F.broadcast(centroid_frame(queries, centroids)))
    d = near.withColumn("d", distance(space, F.col("qvec"), F.col("centroid")))
    w = Window.partitionBy("query_id").orderBy("d", "cid")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= nprobe).select("query_id", "qvec", "cid")


def search(queries: DataFrame, lists: DataFrame, centroids: list[list[float]], nprobe: int, k: int, space: str = "l2") -> DataFrame:
    """Exact distances within the probed lists of ``lists(cid, id, vector)``, of which rows meet the queries that probe
    their list, in blocks."""
    task = scan.Task(name(space), k)
    return ranked(candidates(queries, lists, task, lists=(centroids, nprobe, lambda q: probes(q, centroids, nprobe, space))), k)


def build(docs: DataFrame, nlist: int, space: str = "l2", max_iter: int = 40, sample: int | None = None) -> tuple[list[list[float]], DataFrame]:
    """Train on all rows, or on ``sample`` of them by hash of id, and assign every row."""
    fit = docs if sample is None else docs.orderBy(F.xxhash64("id"), "id").limit(sample)
    centroids = kmeans.train(fit, nlist, max_iter)
    return centroids, kmeans.assign(docs, centroids, space)
