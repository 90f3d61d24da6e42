"""Near copies by their word shingles: an exact join of sets by Jaccard similarity, which completes SimHash.

A text is the set of the 64-bit hashes of its word shingles; equal sets are one node. Under any order of all shingles,
two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each (prefix filtering), so the
join on those loses no pair. At the first shingle that two sets share, what stands before it is in one set only, so a pair
is taken from a bucket only where enough of both sets is left for the overlap that this similarity of their sizes needs
(positional filtering); every similar pair passes there. What is found is verified on the whole sets, unless the
prefixes share too few shingles for the rest of the sets to make up. The order puts frequent shingles
last; they are told by a sample, which decides how fast the join is and never what it finds.

In each bucket the sets first meet two of it, in two steps: the least one, and the first one, which has the fewest shingles
before the bucket's and so is nearest to what the bucket shares. Where a group of near copies holds a text that its others
are similar to, that one joins them at once. Then buckets of up to ``small`` sets are joined with themselves, and
in larger ones the sets outside the bucket's main component meet all others; pairs of one component, which cannot
change it, are all that is left out, so a huge group of near copies stays linear. Pairs that fingerprints propose are
verified first, and what they link need not be compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import column, cut, drop, small_batches


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), "<u8").view("<i8"))


def _least(n: int, similarity: float) -> int:
    """The least overlap of a set of n with one that is similar."""
    return int(np.ceil(similarity * n - 1e-9))


def _frequent(texts: DataFrame, size: int, part: int = 16, most: int = 100_000) -> np.ndarray:
    """Shingles that several of a sample of texts hold, at most ``most``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size))], ["token"])

    sample = texts.where(F.xxhash64("text", F.lit(3)) % part == 0)
    counted = sample.mapInArrow(scan, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 3")
    return np.sort(counted.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow().column(0).to_numpy())


def _sets(d: DataFrame, size: int, similarity: float, mark: Callable[[str | None], int]) -> DataFrame:
    """``d`` (whose last column is _text) with node, fp (the fingerprint), n (the set's size) and prefix in place of zeros."""
    frequent = _frequent(d.select(F.col("_text").alias("text")), size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            node, fp, n, prefix = [], [], [], []
            for t in b.column(b.num_columns - 1):
                s = shingles(t.as_py(), size)
                often = np.isin(s, frequent, assume_unique=True)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                fp.append(mark(t.as_py()))
                n.append(len(s))
                prefix.append(np.concatenate([s[~often], s[often]])[: len(s) - _least(len(s), similarity) + 1])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefix, np.zeros(0, "i8")])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(node, "u8").view("i8")), pa.array(np.array(fp, "u8").view("i8")), pa.array(n, pa.int32()), lists, *b.columns[5:-1]], b.schema.names[:-1])

    return d.mapInArrow(scan, d.drop("_text").schema)


def _verified(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], size: int, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose texts are similar. ``texts``: rows(rid, text), and nodes(node, rid) that name a set's text.

    Only the texts of sets in pairs are sent on.
    """
    rows, nodes = texts
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = rows.join(nodes.join(ends, "node"), "rid").select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, np.ndarray] = {}
            keep = []
            for u, v, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                for k, x in ((u, s), (v, t)):
                    if k not in own:
                        own[k] = shingles(x.as_py(), size)
                common = len(np.intersect1d(own[u], own[v], assume_unique=True))
                keep.append(common >= similarity * (len(own[u]) + len(own[v]) - common) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(scan, "u long, v long"), "similar")


def _fits(similarity: float):
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9


def _needed(similarity: float):
    """The least overlap of similar sets of n and m."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9)


def _left(similarity: float):
    """Whether sets of n and m, from a shared shingle at i and j on, can hold the overlap: true of the first one that
    similar sets share."""
    return F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _needed(similarity)


def links(rows: DataFrame, texts: tuple[DataFrame, DataFrame], size: int, similarity: float, small: int, proposed: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of ``rows(node, n, prefix)``; their components are those of all similar pairs. The pairs
    ``proposed(u, v)`` are verified first."""
    keyed = rows.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    done = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(cut(df, name))
        return done[-1]

    first = F.min(F.struct("i", "node"))["node"].alias("first")
    met = keyed.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("last"), first).where("least <> last").select("token", "least", "first")
    shared = kept(keyed.join(met, "token").distinct(), "shared")
    shared = shared.join(shared.groupBy("token").agg(F.count("*").alias("held")), "token")
    other = lambda d, *more: d.select("token", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), *more)
    heads = shared.where("node = least or node = first").select("token", F.col("node").alias("u"), "n", "i")
    spare = (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - _needed(similarity)).alias("spare")
    starred = kept(heads.join(other(shared), "token").where("u <> v").where(_fits(similarity)).select("u", "v", spare).groupBy("u", "v").agg(F.max("spare").alias("spare")), "stars")
    # one candidate a set first, the one with most to spare, and what was proposed: most of the others are of one component then
    one = starred.groupBy("v").agg(F.max(F.struct("spare", "u"))["u"].alias("u")).select("u", "v")
    found = _verified(kept(one.unionByName(proposed).distinct(), "candidates"), texts, size, similarity)
    joined = kept(components(found), "joined")
    of = lambda end: joined.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    apart = starred.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
    found = found.unionByName(_verified(kept(apart.select("u", "v"), "candidates"), texts, size, similarity))
    joined = components(found).withColumnRenamed("component", "c")
    shared = kept(shared.join(joined, "node", "left").select("token", "node", "n", "i", "held", F.coalesce("c", "node").alias("c")), "labelled")
    few, many = shared.where(F.col("held") <= small), shared.where(F.col("held") > small)
    own = few.select("token", F.col("node").alias("u"), "n", "i", F.col("c").alias("d"))
    pairs = own.join(other(few, "c"), "token").where("u < v and c <> d").where(_fits(similarity) & _left(similarity)).select("u", "v", "n", "m")
    share = many.groupBy("token", "c").agg(F.count("*").alias("k"))
    main = share.groupBy("token").agg(F.max(F.struct("k", "c"))["c"].alias("main"))
    apart = many.join(main, "token").where("c <> main").select("token", F.col("node").alias("u"), "n", "i", F.col("c").alias("d"), "main")
    rest = apart.join(other(many, "c"), "token").where("c <> d and (c = main or u < v)").where(_fits(similarity) & _left(similarity)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "n", "m")
    apart = kept(pairs.unionByName(rest).groupBy("u", "v").agg(F.min("n").alias("n"), F.min("m").alias("m")), "pairs")
    # Of the two prefixes take the one that ends first in the order: what the sets share up to there is in both, and behind
    # it that set has n - prefix more
    behind = lambda n: F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1
    ends = apart.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    begins = rows.join(ends, "node").groupBy("node").agg(F.first("prefix").alias("p"))  # equal for all rows of a set
    both = apart.join(begins.select(F.col("node").alias("u"), F.col("p").alias("a")), "u").join(begins.select(F.col("node").alias("v"), F.col("p").alias("b")), "v")
    counted = both.withColumn("both", F.size(F.array_intersect("a", "b")))
    enough = counted.where(F.col("both") + F.greatest(behind("n"), behind("m")) >= _needed(similarity)).select("u", "v")
    found = found.unionByName(_verified(kept(enough, "candidates"), texts, size, similarity))
    for t in done:
        drop(t)
    return found


def deduplicated(docs: DataFrame, mark: Callable[[str | None], int], near: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, small: int = 64) -> DataFrame:
    """One row of each class of near copies, columns as they were: the one of least id (a null id comes last).

    A class is what pairs of a Jaccard similarity of ``similarity`` or more link. ``mark`` makes a text's fingerprint and
    ``near`` the pairs ``(u, v)`` of close ones among distinct ``fp``. Texts without words are copies of each other. Of
    rows that repeat the least id within the class one stays. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    zero = F.lit(0).cast("long")
    zeros = [zero.alias("node"), zero.alias("fp"), F.lit(0).alias("n"), F.array().cast("array<long>").alias("prefix"), F.monotonically_increasing_id().alias("rid")]
    d = docs.select(column(id_col).cast("long").alias("doc_id"), *zeros, *[column(c).alias(f"k{i}") for i, c in enumerate(docs.columns)], column(text_col).cast("string").alias("_text"))
    rows = cut(_sets(d, size, similarity, mark), "sets")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head")
    nodes = cut(rows.groupBy("node").agg(head, F.min("fp").alias("fp")), "nodes")
    # sets of one fingerprint meet the least of them, and these each other
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    close = near(least.select("fp")).join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    proposed = same.unionByName(close.select(F.col("a").alias("u"), F.col("b").alias("v"))).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # the texts of sets are read by their rows' numbers, so that a set's copies are not sent
    texts = (rows.select("rid", F.col(f"k{docs.columns.index(text_col)}").cast("string").alias("text")), nodes.select("node", F.col("head.rid").alias("rid")))
    joined = components(links(rows.select("node", "n", "prefix"), texts, size, similarity, small, proposed))
    classes = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = classes.groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.rid").alias("rid"))
    return rows.join(heads, "rid", "left_semi").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
