from collections import defaultdict

import numpy as np
import xxhash

from vecspark.llm import simhash
from vecspark.llm.queries import QUERIES


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute(rows):
    """(doc_id, fp) to sorted (doc_id, hex, component)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fps = np.array([fp for _, fp in rows], "u8")
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 2):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(str(d), f"{fp:016x}", str(least.get(find(i)))) for i, (d, fp) in enumerate(rows)])


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got(QUERIES["op2_simhash"](spark, sf_dir)) == brute([(r["doc_id"], plain(r["text"])) for r in docs])


def test_edges(spark, edge_docs):
    rows = edge_docs.collect()
    assert got(simhash.near_duplicates(edge_docs)) == brute([(r["doc_id"], plain(r["text"])) for r in rows])
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark, edge_docs):
    kept = simhash.deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns
    classes = {c for _, _, c in brute([(r["doc_id"], plain(r["text"])) for r in edge_docs.collect()])}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(classes)
    assert simhash.deduplicated(edge_docs.limit(0)).count() == 0


def test_large_buckets_lose_no_component(spark):
    """Thousands of fingerprints that share a pair of blocks: no pair is listed, every component is found."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = {base ^ int(m) for m in rng.integers(0, 1 << 20, 1500)} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype("i8")),) for x in fps], "fp long")
    expected = brute(list(enumerate(fps)))
    for small in (1, 64, 10_000):
        found = simhash._classes(df, 2, small).collect()
        groups = defaultdict(set)
        for r in found:
            groups[r["component"]].add(fps.index(int(np.int64(r["fp"]).astype("u8"))))
        label = {i: min(g) for g in groups.values() for i in g}
        assert sorted((str(i), f"{fp:016x}", str(label[i])) for i, fp in enumerate(fps)) == expected
