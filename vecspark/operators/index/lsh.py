"""Random-projection buckets (pyspark.ml) as a further approximate path for squared L2."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scan
from ..topk import ranked


def search(queries: DataFrame, corpus: DataFrame, k: int, radius: float, bucket: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """Rows within ``radius`` (not squared) that share a bucket with the query; the k nearest of each.

    Both sides are hashed by the model, a row once. Buckets hold a large part of the rows, so a join on them lists nearly
    all pairs, with their vectors, up to ``tables`` times; blocks of rows and tiles of queries compare their hashes instead.
    """
    side = lambda df, i, v: df.select(F.col(i).alias("key"), array_to_vector(F.col(v).cast("array<double>")).alias("features"), F.col(v).alias("plain"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    c, q = side(corpus.select("id", "vector").distinct(), "id", "vector"), side(queries.select("query_id", "qvec").distinct(), "query_id", "qvec")
    model = model.fit(c)
    hashes = F.array(*[vector_to_array(F.col("hashes")[t])[0] for t in range(tables)]).alias("hashes")
    hashed = lambda df, i, v: model.transform(df).select(F.col("key").alias(i), F.col("plain").alias(v), hashes)

    def joined(q: DataFrame, c: DataFrame) -> DataFrame:
        pairs = model.approxSimilarityJoin(q.drop("plain"), c.drop("plain"), radius, "d")
        return pairs.select(F.col("datasetA.key").alias("query_id"), F.col("datasetB.key").alias("id"), (F.col("d") * F.col("d")).alias("distance"))

    found, dim, odd = scan.parts(hashed(q, "query_id", "qvec"), ["query_id", "qvec", "hashes"])
    q_type, out = queries.schema["query_id"].dataType.simpleString(), []
    task = scan.Task("l2", k, radius * radius * (1 + 1e-9), inner=radius)
    for rows, at, x in found:
        if len(at):
            taken = rows.take(pa.array(at))
            own = scan.whole(taken.column("hashes")).flatten().to_numpy(zero_copy_only=False).reshape(len(at), tables)
            out.append(scan.search(scan.Asked(scan.whole(taken.column("query_id")), x, own), hashed(c, "id", "vector"), task, "id", q_type, dim, "hashes"))
    rest = c.where(~scan.dense("plain", dim) | F.col("key").isNull())
    if not out:
        out.append(joined(q, c))
    else:
        if rest.limit(1).count():
            out.append(joined(q.where(scan.dense("plain", dim)), rest))
        if odd is not None:
            out.append(joined(q.where(~scan.dense("plain", dim)), c))
    return ranked(functools.reduce(DataFrame.union, out), k)
