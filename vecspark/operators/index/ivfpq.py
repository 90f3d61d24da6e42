"""Inverted lists whose members are scored by product-quantized residuals (asymmetric distances, squared L2)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.distance import l2
from ...functions.scalar import residual
from ...operators import kmeans, scan
from ...operators.topk import ranked, small
from . import ivf

KSUB = 256
#: Residuals that fit the code books: a bounded sample by hash of id; every row is encoded.
TRAIN_ROWS = 65_536


def _parts(v: Column, m: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.slice(v, j * width + 1, width))


def _book(like: DataFrame, books: list[list[list[float]]]) -> DataFrame:
    return F.broadcast(like.sparkSession.createDataFrame([(books,)], "_books array<array<array<double>>>"))


def train_books(residuals: DataFrame, m: int, ksub: int = KSUB, rows: int = TRAIN_ROWS) -> list[list[list[float]]]:
    """One code book per sub-vector of ``residuals(id, residual)``; with at most ksub rows each row is its own code."""
    x = residuals.orderBy(F.xxhash64("id"), "id").limit(rows)
    got = np.array([r[0] for r in x.select("residual").collect()], "f8")
    width = got.shape[1] // m
    return [kmeans.train_local(got[:, j * width : (j + 1) * width], ksub).tolist() for j in range(m)]


def encode(lists: DataFrame, centroids: list[list[float]], books: list[list[list[float]]]) -> DataFrame:
    """Adds codes (array<short>): per sub-vector the nearest code of the residual, the least one of equals.

    Tasks compare batches of residuals with a book by matrix products; rows that cannot take part there are folded.
    """
    m, width = len(books), len(books[0][0])
    near, book = np.asarray(centroids, "f8"), np.asarray(books, "f8")
    dim = m * width

    @F.arrow_udf("array<short>")
    def coded(vector: pa.Array, cid: pa.Array) -> pa.Array:
        _, x = scan.matrix(vector, dim)  # all take part
        r = x - near[cid.to_numpy(zero_copy_only=False)]
        codes = [scan.closest(np.ascontiguousarray(r[:, j * width : (j + 1) * width]), book[j]) for j in range(m)]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(r) * m + 1, m, dtype="i4")), pa.array(np.stack(codes, axis=1).astype("i2").ravel()))

    usual = scan.dense("vector", dim) & F.col("cid").isNotNull()
    fast = lists.where(usual).withColumn("codes", coded("vector", "cid"))
    with_centroid = lists.where(~usual).join(F.broadcast(ivf.centroid_frame(lists, centroids)), "cid").crossJoin(_book(lists, books))
    parts = _parts(residual(F.col("vector"), F.col("centroid")), m, width)
    code = lambda p, book: kmeans.closest(p, book).cast("short")
    return fast.unionByName(with_centroid.withColumn("codes", F.zip_with(parts, F.col("_books"), code)).drop("centroid", "_books"))


def search(queries: DataFrame, encoded: DataFrame, centroids: list[list[float]], books: list[list[list[float]]], nprobe: int, k: int, rerank: int = 0) -> DataFrame:
    """The k least sums of table look-ups; rows of a list, put together from their codes, bound the sums in blocks.

    ``rerank`` = r > 0 rescores the best k * r candidates by their exact distance.
    """
    m, width, ksub = len(books), len(books[0][0]), min(len(b) for b in books)
    found, dim, odd = scan.parts(queries, ["query_id", "qvec"])
    task, q_type, out = scan.Task("l2", k * rerank if rerank else k), queries.schema["query_id"].dataType.simpleString(), []
    usual = F.coalesce((F.size("codes") == m) & F.forall("codes", lambda c: (c >= 0) & (c < ksub)), F.lit(False)) & F.col("id").isNotNull() & F.col("cid").isNotNull()
    if dim == m * width:
        for rows, at, q in found:
            if len(at):
                asked = scan.Asked(scan.whole(rows.column("query_id")).take(pa.array(at)), q, scan.nearest(q, centroids, nprobe).tolist())
                out.append(scan.search(asked, encoded.where(usual), task, "id", q_type, dim, "cid", (np.asarray(centroids, "f8"), np.stack([np.asarray(b[:ksub], "f8") for b in books]))))
    if out:
        out.append(_folded(queries.where(scan.dense("qvec", dim)), encoded.where(~usual), centroids, books, nprobe))
    if odd is not None or not out:
        out.append(_folded(queries if not out else odd, encoded, centroids, books, nprobe))
    hits = functools.reduce(DataFrame.union, out)
    if not rerank:
        return ranked(hits, k)
    best = ranked(hits, k * rerank).select("query_id", "id").join(queries.select("query_id", "qvec"), "query_id")
    again = encoded.select("id", "vector").join(F.broadcast(best) if small(queries, "qvec", 1 << 20) else best, "id")
    return ranked(again.select("query_id", "id", l2(F.col("qvec"), F.col("vector")).alias("distance")), k)


def _folded(queries: DataFrame, encoded: DataFrame, centroids: list, books: list, nprobe: int) -> DataFrame:
    """Sums of look-ups of all pairs, as columns."""
    m, width = len(books), len(books[0][0])
    asked = ivf.probes(queries, centroids, nprobe).join(F.broadcast(ivf.centroid_frame(queries, centroids)), "cid").crossJoin(_book(queries, books))
    parts = _parts(residual(F.col("qvec"), F.col("centroid")), m, width)
    table = F.zip_with(parts, F.col("_books"), lambda p, book: F.transform(book, lambda c: l2(p, c)))
    asked = asked.select("query_id", "qvec", "cid", table.alias("table"))
    asked = F.broadcast(asked) if small(queries, "qvec", 1 << 20) else asked
    score = F.aggregate(F.zip_with("codes", "table", lambda c, t: F.get(t, c.cast("int"))), F.lit(0.0), lambda s, v: s + v)
    return encoded.select("cid", "id", "codes").join(asked.drop("qvec"), "cid").select("query_id", "id", score.alias("distance"))


def build(docs: DataFrame, nlist: int, m: int, max_iter: int = 40) -> tuple[list, list, DataFrame]:
    centroids, lists = ivf.build(docs, nlist, "l2", max_iter)
    residuals = lists.join(F.broadcast(ivf.centroid_frame(lists, centroids)), "cid").select("id", residual(F.col("vector"), F.col("centroid")).alias("residual"))
    books = train_books(residuals, m)
    return centroids, books, encode(lists, centroids, books)
