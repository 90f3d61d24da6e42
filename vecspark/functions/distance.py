"""Distances between two array columns, as left-to-right folds in double precision, and their numpy twins."""

from __future__ import annotations

import enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Space(str, enum.Enum):
    L2 = "l2"
    IP = "ip"
    COS = "cos"
    HAMMING = "hamming"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return _sum(F.transform(_double(a), lambda x: x * x))


def l2(a: Column, b: Column) -> Column:
    """Squared, without a root."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def ip(a: Column, b: Column) -> Column:
    return F.lit(0.0) - dot(a, b)


def ip_hnsw(a: Column, b: Column) -> Column:
    """Graph libraries' offset form, 1 - dot; it orders like :func:`ip`."""
    return F.lit(1.0) - dot(a, b)


def cos(a: Column, b: Column) -> Column:
    """One less the cosine; exactly one if either vector is zero or empty."""
    na, nb = squared_norm(a), squared_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.sqrt(na * nb))


def hamming(a: Column, b: Column) -> Column:
    """Positions with unequal values."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v)).cast("double")


def name(space: str) -> str:
    """The plain name of a space; l2 for unknown ones."""
    plain = str(getattr(space, "value", space))
    return plain if plain in ("ip", "cos", "hamming") else "l2"


def distance(space: str, a: Column, b: Column) -> Column:
    """The distance of a space; squared L2 for unknown ones."""
    return {"l2": l2, "ip": ip, "cos": cos, "hamming": hamming}[name(space)](a, b)


def np_distance(space: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every row of q to every row of x, by matrix products; equal to the folds up to rounding."""
    q, x = np.asarray(q, "f8"), np.asarray(x, "f8")
    if space == "hamming":
        return np.stack([(row != x).sum(axis=1) for row in q]).astype("f8") if len(q) else np.zeros((0, len(x)))
    products = q @ x.T
    if space == "ip":
        return -products
    nq, nx = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
    if space == "cos":
        norm = np.sqrt(nq * nx)
        return np.where(norm == 0, 1.0, 1.0 - products / np.where(norm == 0, 1.0, norm))
    return nq + nx - 2 * products
