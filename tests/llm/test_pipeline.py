"""Every stage against the operator that it applies, over awkward documents, and the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vecspark.llm import bpe, mixing, privacy, rules, simhash
from vecspark.llm.queries import TARGETS, ranks_path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names clash or hold dots."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    text = "word " * 30 + "a@b.cd " + "tail of many words " * 20
    extra = [(900, None, "en", "src0", None), (901, "", None, None, 0), (902, text, "de", "src1", len(text)), (902, text, "de", "src1", len(text)), (None, None, None, None, None), (903, "long " * 30_000, "fr", "src2", 150_000)]
    rows = real.unionByName(spark.createDataFrame(extra, real.schema))
    return rows.withColumns({"_rid": F.lit(1), "a.b": F.col("lang"), "rid": F.lit("r"), "size": F.lit(2.5), "node": F.lit(0)})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_is_the_rules(spark, sf_dir, docs):
    out = corpus_pipeline.quality(spark, docs, sf_dir)
    assert out.columns == docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = [r["doc_id"] for r in rules.judge(docs, labels).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in out.collect())
    assert 0 < len(kept) < docs.count() and {900, 901, None}.isdisjoint(kept)
    assert set(rows(out)) <= set(rows(docs))


def test_near_copies_are_simhash_completed(spark, sf_dir, docs):
    out = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns and set(rows(out)) <= set(rows(docs))
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(902) == 1 and ids.count(900) == 1 and 901 not in ids and None not in ids
    assert set(ids) <= {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}


def test_personal_data_is_the_sanitiser(spark, sf_dir, docs):
    out = corpus_pipeline.personal_data(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = privacy.sanitise(docs).select("doc_id", "text")
    assert rows(out.select("doc_id", "text")) == rows(want)
    assert out.where("n_chars <> char_length(text)").count() == 0
    assert all("a@b.cd" not in (r["text"] or "") for r in out.collect())


def test_mixture_is_the_draw(spark, sf_dir, docs):
    out = corpus_pipeline.mixture(spark, docs, sf_dir)
    assert out.columns == docs.columns and set(rows(out)) <= set(rows(docs))
    want = mixing.mix(docs, TARGETS, {"topic": mixing.form()}, scarce="yield").where("sampled")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in want.collect())


def test_tokens_are_the_codec(spark, sf_dir, docs):
    out = corpus_pipeline.tokens(spark, docs, sf_dir)
    assert rows(out) == rows(bpe.round_trip(docs, ranks_path(), with_ids=True))
    assert out.count() == docs.count()


def test_empty_tables_stay_empty(spark, sf_dir, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_applies_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf_dir).collect(), d.schema)
    want = corpus_pipeline.tokens(spark, d, sf_dir)
    assert rows(out) == rows(want) and out.count() > 20
