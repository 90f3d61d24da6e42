"""Text to vectors through a provider: any callable from a list of texts to a list of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyParameter, InvalidDimension

Provider = Callable[[list[str]], list[list[float]]]


class HashingProvider:
    """Signed word hashing into a fixed number of dimensions, of unit length: deterministic, and needs no network."""

    def __init__(self, dimension: int):
        if dimension <= 0:
            raise InvalidDimension(str(dimension))
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()


def embed(text: Column, provider: Provider | None, batch: int = 64) -> Column:
    """A column of array<float>, a provider call per ``batch`` texts of an Arrow batch; a null text gives null."""
    if provider is None:
        raise EmptyParameter("no embedding provider is set")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            at = np.flatnonzero(s.notna().to_numpy())
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                for n, v in zip(part, provider(s.iloc[part].tolist())):
                    out.iat[n] = np.asarray(v, "f4")
            yield out

    return run(text)


def auto_embed(docs: DataFrame, provider: Provider | None, text_key: str = "text") -> DataFrame:
    """Fill missing vectors of rows whose parameters say ``"embedding": true`` from their text parameter."""
    flag = F.try_variant_get(F.try_parse_json("parameters"), F.lit("$.embedding"), "boolean")
    wanted = F.coalesce(flag, F.lit(False)) & (F.col("vector").isNull() | (F.size("vector") == 0))
    if provider is None:
        return docs.where(F.when(wanted, F.raise_error(F.lit("no embedding provider is set")).cast("boolean")).otherwise(True))
    text = F.when(wanted, F.get_json_object("parameters", f"$.{text_key}"))
    return docs.withColumn("vector", F.coalesce(embed(text, provider), F.col("vector").cast("array<float>")))
