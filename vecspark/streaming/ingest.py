"""Structured Streaming into collections: micro-batch upserts, and last write wins as a stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..engine import Engine


def upsert_stream(engine: Engine, name: str, log: DataFrame, checkpoint: str, available_now: bool = True):
    """Start a query that applies ``log(id, vector, parameters, deleted, seq)`` to a collection.

    A batch becomes one version of the store; the batch's number is part of the state, so that a batch that is run
    again after a failure is not applied twice: both are one version. ``seq`` orders the rows of a batch; a row of a later
    batch replaces those of batches before, so a log must not deliver an id's rows late over batches
    (:func:`latest` tells late rows apart).
    """

    def apply(batch: DataFrame, number: int) -> None:
        store = engine.store(name)
        state = store.manifest()["state"]
        if state.get("stream", {}).get(checkpoint, -1) >= number:
            return
        newest = batch.groupBy("id").agg(F.max_by(F.struct("vector", "parameters", "deleted"), "seq").alias("r")).select("id", "r.*")
        rows = _assigned(newest, state, engine.spec(name).space) if state.get("centroids") else newest.withColumn("cid", F.lit(None).cast("int"))
        store.append(rows, state | {"stream": state.get("stream", {}) | {checkpoint: number}})

    writer = log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _assigned(rows: DataFrame, state: dict, space: str) -> DataFrame:
    from ..operators import kmeans

    return kmeans.assign(rows, state["centroids"], space)


def latest(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value", deleted: str = "deleted") -> DataFrame:
    """The newest (seq, value, deleted) of each key, emitted whenever it changes; late rows do not win."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, changed = state.get if state.exists else (None, None, None), False
        for pdf in pdfs:
            for s, v, d in zip(pdf[seq], pdf[value], pdf[deleted]):
                if best[0] is None or s > best[0]:
                    best, changed = (int(s), v, bool(d)), True
        if changed:
            state.update(best)
            yield pd.DataFrame({"key": [k[0]], "seq": [best[0]], "value": [best[1]], "deleted": [best[2]]})

    rows = log.select(F.col(key).cast("string").alias(key), F.col(seq).cast("long").alias(seq), F.col(value).cast("string").alias(value), F.col(deleted).cast("boolean").alias(deleted))
    return rows.groupBy(key).applyInPandasWithState(step, "key string, seq long, value string, deleted boolean", "seq long, value string, deleted boolean", "update", GroupStateTimeout.NoTimeout)
