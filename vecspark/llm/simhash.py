"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and a Hamming check.

A 64-bit fingerprint falls into four 16-bit blocks. Two fingerprints at most two bits apart differ in at most two
blocks, so they share at least one of the six pairs of blocks; each pair of blocks is a 32-bit join key. Buckets
of up to ``small`` distinct fingerprints are joined with themselves and verified. In a larger bucket the pairs are
not listed: each fingerprint meets the others at the points at most one bit away from it (two fingerprints within
two bits share such a point, and two that share one are within two bits), and is linked to the least one there,
which is again verified. That is linear in the bucket and loses no component.

Equal texts have equal fingerprints and take part as one node, so a huge group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .components import components
from .tables import column, cut, small_batches

BLOCKS, BITS = 4, 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; zero for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), "<u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="u4")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """``(doc_id long, fp long)`` of every row; fp is the fingerprint's bits as a signed long.

    The columns in ``keep`` follow as k0, k1 and so on; ``numbered`` adds a number of the row, rid.
    """
    small_batches(docs.sparkSession)
    d = docs.select(column(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("fp"), *[F.monotonically_increasing_id().alias("rid")] * numbered, *[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column(text_col).cast("string").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:-1]], b.schema.names[:-1])

    return d.mapInArrow(scan, d.drop("_text").schema)


def links(fps: DataFrame, distance: int = 2, small: int = 64) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp``; their components are those of all pairs within two bits."""
    if distance > BLOCKS - 2:
        raise ValueError(f"{BLOCKS} blocks prove a shared pair for at most {BLOCKS - 2} differing bits")
    block = [F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    pairs = list(combinations(range(BLOCKS), 2))
    keys = F.array(*[F.struct(F.lit(n).alias("p"), F.shiftleft(block[i], BITS).bitwiseOR(block[j]).alias("k")) for n, (i, j) in enumerate(pairs)])
    keyed = fps.select("fp", F.explode(keys).alias("b")).select("fp", F.col("b.p").alias("p"), F.col("b.k").alias("k"))
    sizes = keyed.groupBy("p", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["p", "k"]), "blocks")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    few = shared.where(F.col("n") <= small).select("p", "k", "fp")
    pairwise = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["p", "k"]).where(F.col("u") < F.col("v")).where(near("u", "v"))

    def points(p: int) -> F.Column:
        free = [b for i in range(BLOCKS) if i not in pairs[p] for b in range(BITS * i, BITS * (i + 1))]
        masks = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in free]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))

    around = F.lit(None).cast("array<long>")
    for p in reversed(range(len(pairs))):
        around = F.when(F.col("p") == p, points(p)).otherwise(around)
    met = shared.where(F.col("n") > small).select("p", "fp", F.explode(around).alias("point"))
    least = met.groupBy("p", "point").agg(F.min("fp").alias("u"), F.count("*").alias("m")).where("m > 1").drop("m")
    starred = met.join(least, ["p", "point"]).select("u", F.col("fp").alias("v")).where("u <> v").where(near("u", "v"))
    return pairwise.select("u", "v").unionByName(starred).distinct()


def _classes(nodes: DataFrame, distance: int, small: int) -> DataFrame:
    """``fp, component`` for every ``nodes(fp)``, which are distinct."""
    joined = components(links(nodes, distance, small))
    return nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, small: int = 64) -> DataFrame:
    """One row per document: ``doc_id, fingerprint (16 hex digits), component_id, n_copies, kept``.

    component_id is the least doc_id reachable over fingerprints at most ``distance`` bits apart, and kept marks the
    document that bears it. Null and empty texts have fingerprint zero and are linked like any other; rows that
    repeat a doc_id are all returned; an empty table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = nodes.join(_classes(nodes.select("fp"), distance, small), "fp")
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_copies"))
    member = classes.select("fp", "component").join(heads, "component").select("fp", "component_id", "n_copies")
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, small: int = 64, similarity: float | None = None, size: int = 5) -> DataFrame:
    """One row of each class of near duplicates, columns as they were: the one of least id (a null id comes last).

    With ``similarity``, close fingerprints only propose pairs, which count if the texts' sets of ``size``-word shingles are
    that similar (Jaccard); the similar pairs that fingerprints miss are added by the exact join of :mod:`.similar`.

    Of rows that repeat that id within the class one stays. An empty table gives no rows.
    """
    if similarity is not None:
        return similar.deduplicated(docs, lambda t: fingerprint(t, shingle), lambda fps: links(fps, distance, small), id_col, text_col, size, similarity, small)
    rows = cut(fingerprints(docs, id_col, text_col, shingle, tuple(docs.columns), numbered=True), "fingerprints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("rid").alias("rid"))).alias("head")
    nodes = rows.groupBy("fp").agg(head)
    classes = nodes.join(_classes(nodes.select("fp"), distance, small), "fp")
    heads = classes.groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.rid").alias("rid"))
    return rows.join(heads, "rid", "left_semi").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
