import math

import numpy as np

from vecspark.llm import vectors
from vecspark.llm.queries import QUERIES


def brute(rows, threshold=0.95):
    """(vec_id, vector) to {position: (n_links, component_id, kept)}."""
    ok = [v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v) and d is not None for d, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], "f8"), np.array(rows[j][1], "f8")
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j), key=lambda r: rows[r][0])] = min(find(i), find(j), key=lambda r: rows[r][0])
    return sorted(((d, links[i], rows[find(i)][0], d is not None and rows[find(i)][0] == d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(QUERIES["op10_vectors"](spark, sf_dir)) == brute(rows)


def clusters(n, seed, dim=16, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(e) for e in v]) for i, v in enumerate(x.astype("f4"))]


def test_many_cells_and_blocks_find_every_link(spark):
    """Small blocks and a hot cell: pairs across blocks and borders are counted once each."""
    rows = clusters(600, 1) + [(600 + i, [1.0] * 8 + [0.001 * i] * 8) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(vectors.near_duplicates(df, block=32)) == brute(rows)


def test_recall_of_the_index(spark):
    """Linked pairs found with the production margin, against all pairs."""
    rows = clusters(3000, 2, 32, 0.16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((np.triu(x @ x.T, 1) >= 0.95).sum()) * 2
    found = sum(r[1] for r in got(vectors.near_duplicates(df)))
    assert true > 1000 and 0.9 * true <= found <= true


def test_bad_vectors_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None), (10, [1e-30, 0.0]), (11, [-1.0, 0.0]), (12, [3e38, 1e37])]
    df = spark.createDataFrame([(*r, 0, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, n int")
    assert got(vectors.near_duplicates(df)) == brute(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_the_wide_margin_is_exact(spark):
    rows = clusters(900, 5, 24, 0.2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    assert sum(r[1] for r in want) > 100
    assert got(vectors.near_duplicates(df, margin=0.3163)) == want


def test_planted_vectors_equal_sql(spark, sf_dir):
    import duckdb

    from vecspark.llm.queries import ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLE['planted_vectors']})").fetchall()
    found = got(QUERIES["planted_vectors"](spark, sf_dir))
    assert found == sorted(want, key=str) and 100 < sum(r[1] > 0 for r in found) < len(found)


def test_no_link_is_missed_by_default(spark):
    """Rows in several parts and blocks, with the production parameters."""
    from vecspark.operators import scan

    rows = clusters(3000, 2, 32, 0.16)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    before = scan.QUERY_BYTES
    try:
        scan.QUERY_BYTES = 200_000
        found = {r[0]: r[1] for r in got(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))}
    finally:
        scan.QUERY_BYTES = before
    assert [found[i] for i in range(3000)] == want.tolist()
