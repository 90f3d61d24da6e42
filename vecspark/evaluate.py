"""Recall and throughput of searches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, hits, expected, recall`` of each query of ``truth(query_id, id)``."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("expected"), (F.count("hit") / F.count("*")).alias("recall"))


def throughput(run: Callable[[], DataFrame], n_queries: int, repeats: int = 3) -> float:
    """Queries a second of the best of some runs, each run to its end."""
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return n_queries / best


def sweep(runs: dict[str, Callable[[], DataFrame]], truth: DataFrame, n_queries: int) -> list[dict]:
    """One row of throughput and mean recall for each setting."""
    out = []
    for name, run in runs.items():
        mean = recall(run(), truth).agg(F.avg("recall")).first()[0]
        out.append({"setting": name, "qps": throughput(run, n_queries), "recall": mean})
    return out


def log_statistics(lines: DataFrame) -> DataFrame:
    """Counts of log lines by level; ``lines(value)``."""
    level = F.upper(F.regexp_extract("value", r"(?i)\b(debug|info|warn|error)\b", 1))
    return lines.groupBy(F.when(level == "", "OTHER").otherwise(level).alias("level")).count()
