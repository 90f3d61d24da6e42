"""Lloyd's k-means as an engine operator: deterministic seeds, ties to the least index, ordered sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyParameter, InvalidDimension, InvalidParameter
from ..functions.distance import distance, name
from . import scan

#: Training vectors of at most so many bytes, as counted, are clustered in the driver; more of them in Spark jobs.
LOCAL_BYTES = 32 << 20


def literal(centroids: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def closest(vector: Column, centroids: Column, space: str = "l2") -> Column:
    """Index of the nearest centroid (array of arrays), the least one of equals."""
    d = F.transform(centroids, lambda c: distance(space, vector, c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def cells(column: pa.Array, centroids: np.ndarray, space: str = "l2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that are of the centroids' length and without nulls, these vectors, and their centroids."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dim = centroids.shape[1]
    at, x = scan.matrix(column, dim)
    own = scan.closest(x, centroids, space)
    if len(at) < len(column):  # not finite, or of a size whose square is not
        rest = np.setdiff1d(np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim), at)
        rest = np.array([n for n in rest if not column[int(n)].values.null_count], "i8")
        if len(rest):
            y = column.take(pa.array(rest)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
            with np.errstate(all="ignore"):
                near = scan.nearest(y, centroids, 1, space)[:, 0]
            at, x, own = np.concatenate([at, rest]), np.concatenate([x, y]), np.concatenate([own, near])
    return at, x, own


def assign(df: DataFrame, centroids: list[list[float]], space: str = "l2", column: str = "vector") -> DataFrame:
    """Adds cid, null for a vector of another length or with nulls. Tasks compare batches of vectors with all centroids."""
    c, space = np.asarray(centroids, "f8"), name(space)

    @F.arrow_udf("int")
    def cid(vectors: pa.Array) -> pa.Array:
        at, _, own = cells(vectors, c, space)
        out, known = np.zeros(len(vectors), "i4"), np.zeros(len(vectors), bool)
        out[at], known[at] = own, True
        return pa.array(out, mask=~known)

    return df.withColumn("cid", cid(F.col(column)))


def means(assigned: DataFrame, column: str = "vector") -> DataFrame:
    """``cid, n, total (array<double>)``: partial sums combine in each task before they are shuffled."""
    items = assigned.select("cid", F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    sums = items.groupBy("cid", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("total"))


def ordered_means(assigned: DataFrame, id_col: str = "id", column: str = "vector") -> DataFrame:
    """``cid, pos, value``: means whose sums run in order of id, the same to the last bit on any cluster.

    A cluster's values of one position meet in one row, so this is for checks and for clusters of bounded size.
    """
    items = assigned.select("cid", id_col, F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    listed = items.groupBy("cid", "pos").agg(F.array_sort(F.collect_list(F.struct(id_col, "x"))).alias("xs"))
    return listed.select("cid", "pos", (F.aggregate("xs", F.lit(0.0), lambda s, v: s + v["x"]) / F.size("xs")).alias("value"))


def seeds(df: DataFrame, k: int, order: str = "id", column: str = "vector") -> list[list[float]]:
    """The first k vectors in order of id."""
    return [[float(x) for x in r[0]] for r in df.orderBy(order).select(column).limit(k).collect()]


def train(df: DataFrame, k: int, max_iter: int = 40, order: str = "id", column: str = "vector", require: bool = True) -> list[list[float]]:
    """k centroids under squared L2; stops when no assignment changes, and updates once more after the last one.

    The rounds are jobs of which only k centroids and a count come to the driver, or run there altogether if all
    vectors take at most LOCAL_BYTES. An empty cluster keeps its centroid.
    """
    size = df.agg(F.sum(F.size(column).cast("long") * 8 + 16)).first()[0] or 0
    if size <= LOCAL_BYTES:
        rows = [r[0] for r in df.orderBy(order).select(column).collect()]
        if not rows:
            raise EmptyParameter("no training vectors")
        if require and len(rows) < k:
            raise InvalidParameter(f"{len(rows)} training vectors for {k} centroids")
        return train_local(np.array(rows, "f8"), k, max_iter).tolist()
    centroids = seeds(df, k, order, column)
    if not centroids:
        raise EmptyParameter("no training vectors")
    if require and len(centroids) < k:
        raise InvalidParameter(f"{len(centroids)} training vectors for {k} centroids")
    held, before = scan.spread(df.select(column)).persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        for _ in range(max_iter):
            sums = {r["cid"]: r["total"] for r in _sums(held, np.asarray(centroids, "f8"), before).collect()}
            before = np.asarray(centroids, "f8")
            for cid, (*total, n, _) in sums.items():
                centroids[cid] = [t / n for t in total]
            if not sum(t[-1] for t in sums.values()):
                break
    finally:
        held.unpersist()
    return centroids


def _sums(vectors: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``cid, total``: of each cell the sums of its vectors, their number, and how many the centroids ``before`` put
    elsewhere. A task adds its own up and returns a row a cell."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2))
        for t in scan.blocks(batches):
            at, x, own = cells(t.column(0), centroids)
            if len(at) < t.num_rows:
                raise InvalidDimension(f"a training vector is not of {dim} numbers")
            moved = own != cells(t.column(0), before)[2] if before is not None else np.ones(len(x), bool)
            total += np.stack([np.bincount(own, w, k) for w in [*x.T, np.ones(len(x)), moved.astype("f8")]], axis=1)
        cid = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(cid.astype("i4")), pa.array(total[cid].tolist(), pa.list_(pa.float64()))], ["cid", "total"])

    parts = vectors.mapInArrow(run, "cid int, total array<double>").select("cid", F.posexplode("total").alias("pos", "x"))
    sums = parts.groupBy("cid", "pos").agg(F.sum("x").alias("s"))
    return sums.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("total"))


def train_local(x: np.ndarray, k: int, max_iter: int = 40) -> np.ndarray:
    """The same on a bounded matrix in the driver or one task (product-quantization code books)."""
    k = min(k, len(x))
    c, own = x[:k].astype("f8").copy(), np.zeros(len(x), "i8")
    size = (x * x).sum(1)
    for _ in range(max_iter):
        new = np.empty(len(x), "i8")
        for at in range(0, len(x), 4096):  # distances of a part at a time
            new[at : at + 4096] = (size[at : at + 4096, None] + (c * c).sum(1)[None, :] - 2 * x[at : at + 4096] @ c.T).argmin(axis=1)
        n = np.bincount(new, minlength=k)
        total = np.stack([np.bincount(new, w, k) for w in x.T], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (new == own).all():
            break
        own = new
    return c
