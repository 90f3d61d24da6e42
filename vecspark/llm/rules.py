"""Quality rules as a learned decision list, in DataFrame functions only.

Sequential covering: each rule is a conjunction of thresholds on interpretable features that rejects rows labelled
as bad. A rule grows one condition at a time by FOIL gain, from label counts per feature and bin that Spark
aggregates over the labelled rows not yet covered; it is pruned on rows held back from growing, and kept while its
precision there is at least ``precision``. The driver sees counts only: features x bins x labels rows a step. The
list is emitted as one ordered CASE expression. All labelled rows are used, none are sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column, cut, drop, words

SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "symbols", "dup_lines", "repeats", "upper", "exclaims", "digits", "words_per_line")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(ws: Column) -> Column:
    """Words in 3-word windows found twice or more in ``ws``, the first ones included."""
    last = F.size(ws) - 2
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def cover(s: Column) -> Column:
            again = F.filter(s, lambda e, j: e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, cover))

    return F.when(F.size(ws) < 3, 0).otherwise(let(windows, covered))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, and the rates that rules are made of (all double).

    A column c in ``keep`` follows as k_c.
    """
    kept = [f"k_{c}" for c in keep]
    d = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"), *[column(c).alias(k) for c, k in zip(keep, kept)])
    d = d.withColumn("ws", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = d.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("ws")).cast("long").alias("n_repeat_words"),
        let(lines, F.size).alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("!")).alias("n_exclaims"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
        *[column(k) for k in kept],
    )
    per = lambda a, b, by=100.0: F.when(F.col(b) > 0, F.col(a) * by / F.col(b)).otherwise(0.0)
    rates = {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"), "exclaims": per("n_exclaims", "n_words"), "digits": per("n_digits", "word_chars"), "words_per_line": per("n_words", "n_lines", 1.0), "word_chars": per("word_chars", "n_words", 1.0), "n_words": F.col("n_words").cast("double")}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.struct(*[rates[f].alias(f) for f in FEATURES]).alias("f"), *[column(k) for k in kept])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, f: str = "f") -> Column:
        x = F.col(f)[self.feature]
        return (x >= self.threshold) if self.at_least else (x < self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self, f: str = "f") -> Column:
        out = self.conditions[0].column(f)
        for c in self.conditions[1:]:
            out = out & c.column(f)
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else -1.0


def learn(feats: DataFrame, labels: DataFrame, precision: float = 0.95, min_bad: int = 3, max_conditions: int = 4, max_rules: int = 16, bins: int = 32, tries: int = 6, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """The decision list that rejects rows labelled 0. ``feats`` as :func:`features` gives them.

    Rows without label, with a label other than 0 and 1, or failed by the base rules already take no part. Without
    rows of both labels there is nothing to learn and the list is empty. Thresholds are approximate quantiles and
    the points next to them; ``min_bad`` bad rows held back from growing must support a rule. A grown rule that
    is not precise enough there is given up, and another is grown from a different first condition, up to ``tries`` in a row.
    """
    y = labels.select(column(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = cut(feats.where("not base_failed").join(y, "doc_id").select("f", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")), "labelled")
    quantiles = [(i + 0.5) / bins for i in range(bins)]
    ask = lambda part: rows.where(part).agg(*[F.percentile_approx(F.col("f")[c], quantiles, 10000).alias(c) for c in FEATURES]).first()
    both = [ask("y = 0"), ask("y = 1")]
    cuts = {c: sorted({float(q) for b in both if b[c] for q in b[c]}) for c in FEATURES}
    if not any(cuts.values()):
        drop(rows)
        return []
    at_or_below = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda t: F.col("f")[c] >= t))
    bin_of = F.array(*map(at_or_below, FEATURES))
    binned = cut(rows.select("f", "y", "held", bin_of.alias("b")), "binned")
    drop(rows)

    def counts(part: DataFrame) -> dict[int, list[list[int]]]:
        """Per feature, per bin: how many bad and good rows."""
        out = {i: [[0, 0] for _ in range(len(cuts[c]) + 1)] for i, c in enumerate(FEATURES)}
        for r in part.select("y", F.posexplode("b").alias("i", "b")).groupBy("i", "b", "y").count().collect():
            out[r["i"]][r["b"]][r["y"]] += r["count"]
        return out

    rules: list[Rule] = []
    left, given_up = binned, set()
    while len(rules) < max_rules and len(given_up) < tries:
        grown: list[Condition] = []
        part = left.where("not held")
        while len(grown) < max_conditions:
            table = counts(part)
            bad0, good0 = (sum(x[k] for x in table[0]) for k in (0, 1))
            if not bad0 or not good0:
                break
            best: tuple = (0.0, None)
            for i, c in enumerate(FEATURES):
                bad, good = 0, 0
                for n, t in enumerate(cuts[c]):
                    bad, good = bad + table[i][n][0], good + table[i][n][1]
                    for at_least, b, g in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                        if b >= min_bad and (gain := _gain(b, g, bad0, good0)) > best[0] + 1e-9:
                            found = Condition(c, at_least, float(t))
                            if grown or (c, at_least) not in given_up:
                                best = (gain, found)
            if best[1] is None:
                break
            grown.append(best[1])
            part = part.where(best[1].column())
        if not grown:
            break
        upto = [Rule(tuple(grown[: n + 1]), 0, 0) for n in range(len(grown))]
        sums = [F.coalesce(F.sum((r.column() & (F.col("y") == k)).cast("long")), F.lit(0)).alias(f"{k}_{n}") for n, r in enumerate(upto) for k in (0, 1)]
        held = left.where("held").agg(*sums).first()
        scored = [(held[f"0_{n}"] / max(1, held[f"0_{n}"] + held[f"1_{n}"]), held[f"0_{n}"], -n) for n in range(len(upto))]
        pure, bad, n = max(scored)
        if pure < precision or bad < min_bad:
            given_up.add((grown[0].feature, grown[0].at_least))
            continue
        given_up = set()
        rules.append(Rule(upto[-n].conditions, held[f"0_{-n}"], held[f"1_{-n}"]))
        left = left.where(~rules[-1].column())
    drop(binned)
    return rules


def decide(rules: list[Rule], f: str = "f") -> Column:
    """The ordered conditional expression: the first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(f), F.lit(str(r))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """Base counts, ``base_failed``, ``rule`` (the one that rejects, or null) and ``kept``, a row per document.

    A column c in ``keep`` follows as k_c; it is written beside the features, so that the verdict needs no join.

    A null text has no words and fails the base rules, as a short one does. Repeated rows are judged each; an empty
    table gives no rows; a doc_id with several labels teaches each of them.
    """
    feats = cut(features(docs, id_col, text_col, keep), "features")
    rules = learn(feats, labels, **how)
    rule = F.when(~F.col("base_failed"), decide(rules))
    return feats.withColumn("rule", rule).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", *[column(f"k_{c}") for c in keep])


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that :func:`judge` keeps, columns and rows as they were."""
    # the list is learnt from the labelled documents; the verdict is part of the scan, so no text is written in between
    named = labels.select(column(how.get("id_col", "doc_id")).cast("long").alias("_id")).distinct()
    labelled = docs.select(column(id_col).cast("long").alias("_id"), column(text_col).cast("string").alias("text")).join(named, "_id", "left_semi")
    feats = cut(features(labelled, "_id", "text"), "features")
    rules = learn(feats, labels, **how)
    drop(feats)
    # features are generated, so that the optimizer does not push the verdict below and compute them anew for each condition
    judged = features(docs, id_col, text_col, tuple(docs.columns))
    once = judged.select(F.explode(F.array(F.struct("base_failed", "f"))).alias("_x"), *[column(f"k_{c}") for c in docs.columns])
    verdict = once.where(~F.col("_x.base_failed") & decide(rules, "_x.f").isNull())
    return verdict.select(*[column(f"k_{c}").alias(c) for c in docs.columns])
