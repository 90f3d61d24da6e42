"""Exact nearest neighbours: one query, many queries, within a radius, by distinct document, filtered, hydrated."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DocumentNotFound, InvalidDimension, InvalidParameter
from ..functions.distance import distance, name
from ..functions.filters import matches
from . import scan

#: Bytes of query vectors that are broadcast; beyond, the corpus is joined without a broadcast.
BROADCAST_BYTES = 64 << 20


def check_dimension(df: DataFrame, dimension: int, column: str = "vector") -> DataFrame:
    """``df``, failing at run time on a row whose vector is null or of another length."""
    if dimension <= 0:
        raise InvalidDimension(str(dimension))
    ok = F.col(column).isNotNull() & (F.size(column) == dimension)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{InvalidDimension.message}: expected {dimension}")).cast("boolean")))


def small(df: DataFrame, column: str, most: int = BROADCAST_BYTES) -> bool:
    """Whether the vectors of ``df`` take at most ``most`` bytes, as counted."""
    size = df.agg(F.sum(F.size(column).cast("long") * 8 + 64)).first()[0]
    return (size or 0) <= most


def ranked(pairs: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k least distances of each query, ties by id; Spark keeps k rows a task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "distance")


def pairs(queries: DataFrame, corpus: DataFrame, space: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distance of every query(query_id, qvec) to every row of corpus(id, vector): the query side is broadcast if small."""
    side = F.broadcast(queries) if small(queries, "qvec") else queries
    return corpus.crossJoin(side.select("query_id", "qvec")).select("query_id", "id", distance(space, F.col("qvec"), F.col("vector")).alias("distance"), *keep)


def _check(k: int) -> None:
    if not isinstance(k, int) or k < 1:
        raise InvalidParameter(f"k = {k!r}; at least 1 is needed")


def nearest(corpus: DataFrame, vector: list[float], k: int, space: str = "l2") -> DataFrame:
    """``id, distance`` of the k rows nearest to one vector, in order: a bounded heap in each task, no shuffle."""
    _check(k)
    q = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.select("id", distance(space, q, F.col("vector")).alias("distance")).orderBy("distance", "id").limit(k)


def candidates(queries: DataFrame, corpus: DataFrame, task: scan.Task, id_col: str = "id", lists: tuple[list, int, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``query_id, id, distance`` of at least all pairs that belong to the answer of ``task``, not ranked.

    Blocks of rows meet tiles of queries in :mod:`scan`; the few rows and queries that cannot take part there (nulls, other
    lengths, components that are not finite) are folded as columns. With ``lists`` (centroids, how many a query
    looks at, and a function of queries that gives query_id, qvec, cid) corpus has a cid, and rows of these lists count.
    """
    found, dim, odd = scan.parts(queries, ["query_id", "qvec"])
    q_type = queries.schema["query_id"].dataType.simpleString()
    extra = "cid" if lists else None

    def folded(q: DataFrame, c: DataFrame) -> DataFrame:
        if lists:
            asked = lists[2](q)
            asked = F.broadcast(asked) if small(q, "qvec") else asked
            hits = c.select("cid", "id", "vector").join(asked, "cid").select("query_id", "id", distance(task.space, F.col("qvec"), F.col("vector")).alias("distance"))
        else:
            hits = pairs(q, c.select(F.lit(None).alias("id") if id_col != "id" else "id", "vector", *[id_col] * (id_col != "id")), task.space, (id_col,) if id_col != "id" else ())
            hits = hits.select("query_id", id_col, "distance")
        return hits if task.cap == float("inf") else hits.where(F.col("distance") <= task.cap)

    out = []
    for rows, at, q in found:
        if not len(at):
            continue
        ids, own = scan.whole(rows.column("query_id")).take(pa.array(at)), None
        if lists:
            own = scan.nearest(q, lists[0], lists[1], task.space).tolist()
        out.append(scan.search(scan.Asked(ids, q, own), corpus, task, id_col, q_type, dim, extra))
    if out:
        usual = scan.dense("vector", dim) & F.col(id_col).isNotNull() & (F.col("cid").isNotNull() if lists else F.lit(True))
        hits = folded(queries.where(scan.dense("qvec", dim)), corpus.where(~usual))
        if task.distinct:  # no distance counts only where an id has no other, and the scan keeps k ids of those that have
            known = corpus.where(usual).select(id_col).distinct()
            hits = hits.where("distance is not null").union(hits.where("distance is null").join(known, id_col, "left_anti").select(hits.columns))
        out.append(hits)
    if odd is not None:
        out.append(folded(odd, corpus))
    return functools.reduce(DataFrame.union, out) if out else folded(queries, corpus)


def knn(queries: DataFrame, corpus: DataFrame, k: int, space: str = "l2", filter: dict | Column | None = None, bulk: bool = False) -> DataFrame:
    """``query_id, rank, id, distance``. A filter applies before the search (exact). ``bulk`` is of no effect any more:
    every search scores by matrix products."""
    _check(k)
    if filter is not None:
        corpus = corpus.where(matches(filter) if isinstance(filter, dict) else filter)
    return ranked(candidates(queries, corpus, scan.Task(name(space), k)), k)


def knn_postfilter(queries: DataFrame, corpus: DataFrame, k: int, space: str, condition: Column, overfetch: int = 2) -> DataFrame:
    """Search k * overfetch rows first, then filter: may return fewer than k."""
    hits = knn(queries, corpus, k * overfetch, space)
    return ranked(hits.drop("rank").join(corpus.where(condition).select("id"), "id", "left_semi"), k)


def within(queries: DataFrame, corpus: DataFrame, epsilon: float, space: str = "l2", most: int | None = None) -> DataFrame:
    """All rows at most epsilon away (inclusive), at most ``most`` a query if given."""
    hits = candidates(queries, corpus, scan.Task(name(space), most or 0, float(epsilon)))
    return ranked(hits, most if most is not None else (1 << 31) - 1)


def knn_documents(queries: DataFrame, corpus: DataFrame, k: int, space: str = "l2", doc_col: str = "doc") -> DataFrame:
    """The k nearest distinct documents, each as near as its nearest vector."""
    best = candidates(queries, corpus, scan.Task(name(space), k, distinct=True), doc_col).groupBy("query_id", doc_col).agg(F.min("distance").alias("distance"))
    return ranked(best, k, doc_col)


def hydrate(hits: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """Hits with the columns of their documents; ``strict`` fails on a hit without document. Hits are k a query."""
    if not strict:
        return docs.join(hits, "id")
    lost = F.raise_error(F.concat(F.lit(DocumentNotFound.message + ": "), F.col("id").cast("string"))).cast("boolean")
    marked = hits.join(docs.withColumn("_found", F.lit(True)), "id", "left")
    return marked.where(F.when(F.col("_found"), True).otherwise(lost)).drop("_found")
