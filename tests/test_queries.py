"""The catalogue against DuckDB, as the driver compares it."""

import duckdb
import pytest

from vecspark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(core.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(repr(norm(tuple(r))) for r in df.select(*cols).collect()) == sorted(repr(norm([r[i] for i in at])) for r in want.fetchall())


@pytest.mark.parametrize("name,floor", [("ivf_trained_search", 0.9), ("ivfpq_trained_search", 0.5), ("ivfpq_rerank_search", 0.9), ("hnsw_graph_search", 0.9), ("lsh_search", 0.9)])
def test_recall_of_approximate_searches(spark, sf_dir, name, floor):
    exact = {(r["query_id"], r["id"]) for r in core.QUERIES["knn_l2"](spark, sf_dir).collect()}
    found = {(r["query_id"], r["id"]) for r in core.QUERIES[name](spark, sf_dir).collect()}
    assert len(found & exact) >= floor * len(exact)


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "distance"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
