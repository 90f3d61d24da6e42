"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells, one for each combination of the values that the targets name (all other values of a
dimension share the value ``*``), so the number of cells is bounded by the targets and not by the data: one
aggregation, combined in each task, gives their tokens; a hot source is one row a task. Raking scales the cells in
turn to each marginal until all agree; that gives each cell its weight. Sampling cannot keep a document more than once,
so probabilities are raked with the bound 1 built in (each step solves for the factor that meets its marginal with
full cells full); if the budget cannot meet the targets that way, it is lowered to the largest one that can.

A few long documents can hold more tokens than a target. So the draw goes from the longest documents to the shortest, in
classes of powers of two of their length: what a class missed or exceeded is made up by the classes after it, whose
probabilities are raked to what is left of each marginal. That is one small aggregation a class.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, column, cut

OTHER = "*"


def form(text: str = "text") -> Column:
    """A stand-in for a topic label: the form of a text (tabular, note, article or long)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "tabular").when(F.char_length(t) < 600, "note").when(F.char_length(t) < 4000, "article").otherwise("long")


def _marginal(table: np.ndarray, axis: int) -> np.ndarray:
    return table.sum(axis=tuple(i for i in range(table.ndim) if i != axis))


def _along(values: np.ndarray, axis: int, ndim: int) -> np.ndarray:
    return values.reshape([-1 if i == axis else 1 for i in range(ndim)])


def rake(seed: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-10, max_rounds: int = 2000, strict: bool = True) -> np.ndarray:
    """A table with the marginal shares ``targets`` (one vector for each axis) that is nearest to ``seed``.

    A value that has a target but no mass in the seed gives its share to the others of its dimension. ValueError if the
    rounds do not settle, as where empty cells contradict the targets; the last round's table if not ``strict``.
    """
    w = seed / seed.sum()
    goals = shares(seed, targets)
    for _ in range(max_rounds):
        worst = 0.0
        for axis, t in enumerate(goals):
            now = _marginal(w, axis)
            worst = max(worst, float(np.abs(now - t).max()))
            w = w * _along(np.divide(t, now, out=np.zeros_like(t), where=now > 0), axis, w.ndim)
        if worst < tolerance:
            return w
    if strict:
        raise ValueError(f"raking leaves a marginal {worst:.2g} off its target after {max_rounds} rounds: the documents cannot meet all targets at once")
    return w


def shares(seed: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """The targets as shares of one, without the values that have no mass in the seed."""
    goals = []
    for axis, t in enumerate(targets):
        t = np.where(_marginal(seed, axis) > 0, t, 0.0)
        if t.sum() <= 0:
            raise ValueError(f"dimension {axis}: no value with a target has documents")
        goals.append(t / t.sum())
    return goals


def attainable(goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The shares ``goal``, none above ``most``; what that takes from some goes to the others in proportion."""
    full = np.zeros(len(goal), bool)
    for _ in goal:
        free = goal * ~full
        left = 1 - most[full].sum()
        if left <= 0 or free.sum() <= 0:
            break
        out = np.where(full, most, free / free.sum() * left)
        if (over := ~full & (out > most)).any():
            full |= over
        else:
            return out
    return np.minimum(goal, most) / max(np.minimum(goal, most).sum(), 1e-300)


def _factors(tokens: np.ndarray, ratio: np.ndarray, goals: np.ndarray, most: float = 1e12) -> np.ndarray:
    """For each row the factor f with sum(tokens * min(1, f * ratio)) = goal; ``most`` where all tokens are not enough."""
    order = np.argsort(-ratio, axis=1, kind="stable")
    t, r = np.take_along_axis(tokens, order, 1), np.take_along_axis(ratio, order, 1)
    full = np.cumsum(t, axis=1) - t
    rest = np.cumsum((t * r)[:, ::-1], axis=1)[:, ::-1]
    f = np.divide(goals[:, None] - full, rest, out=np.full(t.shape, most), where=rest > 0)
    fits = f * r <= 1 + 1e-12  # the first cells are full, this one is not
    at = fits.argmax(axis=1)
    return np.where(fits.any(axis=1), np.clip(f[np.arange(len(f)), at], 0.0, most), most)


def bounded(tokens: np.ndarray, ratio: np.ndarray, goals: list[np.ndarray], tolerance: float = 1e-7, max_rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Probabilities min(1, ratio * product of a factor a value) whose kept tokens have the marginals ``goals``.

    Also returns how far the worst marginal is off, as a share of all goals' tokens; ``tolerance`` at most if they can be met.
    """
    n, total = tokens.ndim, max(float(goals[0].sum()), 1e-300)
    factors, off = [np.ones(len(g)) for g in goals], np.inf
    p = np.minimum(1.0, ratio)
    for _ in range(max_rounds):
        for axis, g in enumerate(goals):
            r = ratio
            for other, f in enumerate(factors):
                if other != axis:
                    r = r * _along(f, other, n)
            row = lambda a, axis=axis: np.moveaxis(a, axis, 0).reshape(a.shape[axis], -1)
            factors[axis] = _factors(row(tokens), row(r), g)
            p = np.minimum(1.0, r * _along(factors[axis], axis, n))
        off = max(float(np.abs(_marginal(tokens * p, axis) - g).max()) for axis, g in enumerate(goals)) / total
        if off <= tolerance:
            break
    return p, off


def calibrate(tokens: np.ndarray, goals: list[np.ndarray], budget: float, least: float) -> tuple[np.ndarray, float]:
    """Probabilities that keep ``budget`` tokens with the marginal shares ``goals``, and the budget that was kept to.

    If no probabilities up to 1 do, the budget is lowered to the largest that can be met (within a thousandth of it), but
    not below ``least``.
    """
    ones = np.ones_like(tokens)
    p, off = bounded(tokens, ones, [g * budget for g in goals])
    if off <= 1e-7 or budget <= least:
        return p, budget
    low, high = least, budget
    p, _ = bounded(tokens, ones, [g * low for g in goals])
    while high - low > 1e-3 * budget:
        mid = (low + high) / 2
        q, off = bounded(tokens, ones, [g * mid for g in goals])
        if off <= 1e-7:
            p, low = q, mid
        else:
            high = mid
    return p, low


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], dims: Mapping[str, Column] | None = None, fraction: float = 0.5, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), strict: bool = False, scarce: str = "shrink") -> DataFrame:
    """``doc_id, m_<dimension>..., n_tokens, weight, probability, draw_probability, sampled`` of every document, then
    k_<c> for c in ``keep``.

    ``targets``: per dimension the wanted share of tokens of each value; ``*`` stands for all others (without it,
    they keep the share they have, and the rest is scaled down to make room). A named value without documents gives its
    share to the others. ``dims``: the column behind a dimension, by default the one of its name. ``fraction``: the
    wanted share of all tokens. Where some value has too few of them, ``scarce`` "shrink" keeps to the targets and lowers the
    share to what can meet them, and "yield" keeps to the share: the value has all its tokens drawn, and the others of
    its dimension get what it lacks (lowered then only if the dimensions contradict each other). weight: raked over present tokens of
    the cell; probability: of the cell, so that the expected tokens meet every marginal; draw_probability: of the cell
    and class of length, after what longer documents left to draw; sampled: the draw, a hash of the id, so rows that
    repeat an id share one random number.

    Targets that contradict each other on these documents (no weights meet them) are a ValueError if ``strict``, else a
    warning and the nearest fit. Null is an other value. Texts without words (null and empty ones too) weigh nothing
    in the fit; they are sampled by their cell's probability all the same. Texts of any length are counted whole. An
    empty table gives no rows; columns of any name may be carried, clashing ones and those with dots too.
    """
    names = list(targets)
    cols = {n: (dims or {}).get(n, column(n)).cast("string") for n in names}
    named = {n: [v for v in targets[n] if v != OTHER] for n in names}
    bucket = lambda n: F.when(cols[n].isin(named[n]), cols[n]).otherwise(OTHER) if named[n] else F.lit(OTHER)
    tokens = F.regexp_count(F.coalesce(column(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    keys = [f"m{i}" for i in range(len(names))]  # names may hold dots
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), *[bucket(n).alias(k) for n, k in zip(names, keys)], tokens.alias("n_tokens"), *[column(c).alias(f"k_{c}") for c in keep])
    size = F.length(F.regexp_replace(F.bin("n_tokens"), "^0$", ""))  # binary digits; none for no words
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
    rows = cut(rows.withColumns({"size": size, "draw": draw}), "mix")
    values = {n: [*named[n], OTHER] for n in names}
    shape = [len(values[n]) for n in names]

    def counted(found: list) -> np.ndarray:
        """A table by size and cell: as many entries as the targets have combinations and lengths have digits."""
        out = np.zeros([65, *shape])
        for r in found:
            out[(r["size"], *(values[n].index(r[k]) for n, k in zip(names, keys)))] = r["t"] or 0
        return out

    by_size = counted(rows.groupBy("size", *keys).agg(F.sum("n_tokens").alias("t")).collect())
    have = by_size.sum(axis=0)
    weight = probability = np.zeros_like(have)
    spark, fitted = docs.sparkSession, {}
    typed = "size int, " + ", ".join(f"{k} string" for k in keys) + ", draw_probability double"
    sizes = [int(s) for s in np.flatnonzero(by_size.reshape(65, -1).sum(axis=1))[::-1]]
    if sizes:
        goals = []
        for axis, n in enumerate(names):
            t = np.array([float(targets[n].get(v, 0.0)) for v in values[n]])
            if OTHER not in targets[n]:
                other = _marginal(have, axis)[-1] / have.sum()
                t = np.append(t[:-1] / max(t[:-1].sum(), 1e-300) * (1 - other), other)
            goals.append(t)
        try:
            raked = rake(have, goals)
        except ValueError as e:
            if strict or "raking" not in str(e):
                raise
            warnings.warn(f"mix: {e}; the nearest fit is used", stacklevel=2)
            raked = rake(have, goals, strict=False)
        weight = np.divide(raked * have.sum(), have, out=np.zeros_like(have), where=have > 0)
        goals = shares(have, goals)
        if scarce == "yield":
            goals = [attainable(g, 0.999 * _marginal(have, axis) / (fraction * have.sum())) for axis, g in enumerate(goals)]
        probability, budget = calibrate(have, goals, fraction * have.sum(), min(fraction, 1 / weight.max()) * have.sum())
        left, rest = [g * budget for g in goals], have.copy()
        for s in sizes:
            total = np.mean([g.sum() for g in left])
            p, _ = bounded(rest, probability, [g * (total / max(g.sum(), 1e-300)) for g in left], max_rounds=200)
            fitted[s] = p
            table = spark.createDataFrame([(s, *(values[n][i] for n, i in zip(names, at)), float(p[at])) for at in np.ndindex(have.shape)], typed)
            drawn = rows.where(F.col("size") == s).join(F.broadcast(table), ["size", *keys]).where("draw < draw_probability")  # a row a cell
            got = counted(drawn.groupBy("size", *keys).agg(F.sum("n_tokens").alias("t")).collect())[s] if s != sizes[-1] else 0 * have
            left = [np.maximum(0.0, g - _marginal(got, axis)) for axis, g in enumerate(left)]
            rest = rest - by_size[s]
    cells = [(*(values[n][i] for n, i in zip(names, at)), s, float(weight[at]), float(probability[at]), float(fitted.get(s, probability)[at])) for s in [0, *sizes] for at in np.ndindex(have.shape)]
    table = spark.createDataFrame(cells, ", ".join(f"{k} string" for k in keys) + ", size int, weight double, probability double, draw_probability double")
    out = rows.join(F.broadcast(table), ["size", *keys])  # a row a cell and size
    return out.select("doc_id", *[F.col(k).alias(f"m_{n}") for n, k in zip(names, keys)], "n_tokens", "weight", "probability", "draw_probability", (F.col("draw") < F.col("draw_probability")).alias("sampled"), *[column(f"k_{c}") for c in keep])
