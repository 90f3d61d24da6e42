import hashlib
import random

from vecspark.llm import suffixes
from vecspark.llm.queries import QUERIES


def brute(docs, length):
    """(id, text) in order to (id, n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), []
    for d, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        left = bytes(c for c, g in zip(data, gone) if not g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), n_spans, hashlib.sha256(left).hexdigest()))
    return out


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert got(QUERIES["op4_suffixes"](spark, sf_dir)) == sorted(brute(docs, 100), key=str)


def test_periodic_overlapping_and_shared(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdef ghij\n", k=n))
    shared, period = noise(400), noise(7)
    texts = [noise(300) + shared, shared + noise(50) + shared, "a" * 1000, period * 60, period * 60 + "x", shared[:100], shared[1:100], noise(99), "", None, noise(200) + shared[150:260] + noise(30) + shared[100:320], "日本語" * 90, "é" + "日本語" * 90]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3)
    assert got(suffixes.remove_repeats(df)) == sorted(brute(docs, 100), key=str)


def test_many_random_shapes(spark):
    rng = random.Random(8)
    for n in range(2):
        pool = ["".join(rng.choices("ab", k=rng.randint(90, 300))) for _ in range(6)]
        docs = [(i, "".join(rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 4)))) for i in range(40)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert got(suffixes.remove_repeats(df)) == sorted(brute(docs, 100), key=str)


def test_edges(spark, edge_docs):
    """Repeated and null ids: rows in the order of id (null first), then text."""
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert got(suffixes.remove_repeats(edge_docs)) == sorted(brute(rows, 100), key=str)
    assert suffixes.remove_repeats(edge_docs.limit(0)).count() == 0


def test_scan_holds_little_memory_and_long_texts_are_cut(spark):
    """Ranks of a scan take a multiple of its slice; slices of several MB filled an executor's memory."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    text = "".join(rng.choices("abcdef ghij\n", k=6_000_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["doc", "text"])
    suffixes._powers.clear()
    tracemalloc.start()
    try:
        runs = sum(b.num_rows for b in suffixes._scan(100)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert runs > 6_000_000 // 69 and peak < 150
    shared = text[:700_000]  # longer than a part
    docs = [(1, shared), (2, "x" + shared), (3, text[600_000:900_000])]
    left = {r[0]: r[2] for r in got(suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert left == {1: 0, 2: 700_000, 3: 100_000}
