"""From raw documents to token ids: quality rules, near duplicates, personal data, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage to the shared folder and reads it again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import bpe, mixing, privacy, rules, simhash
from vecspark.llm.queries import TARGETS, ranks_path
from vecspark.llm.tables import column, cut, drop, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    Null, empty and short texts go; repeated rows are judged each; an empty table stays empty. Without labels only the
    base rules apply.
    """
    return rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id (a null id comes last).

    Fingerprints propose pairs, similarity 0.8 of five-word shingles decides, and no similar pair is lost to fingerprints.
    Null and empty texts are copies of each other; of repeated rows one stays; an empty table stays empty.
    """
    return simhash.deduplicated(docs, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the words that disclose it; n_chars follows the text.

    All rows stay, repeated ones each; a null text stays null; an empty table stays empty.
    """
    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that their tokens come in the target shares, or as near as these documents allow.

    Earlier stages take most texts of some forms away; a value with too few tokens keeps all it has, and half of all tokens
    stay. Null sources and languages are other values. Rows that repeat an id share one random number. Texts without words weigh
    nothing and are drawn like their cell. An empty table stays empty.
    """
    drawn = mixing.mix(docs, TARGETS, {"topic": mixing.form()}, keep=tuple(docs.columns), scarce="yield")
    return drawn.where("sampled").select(*[column(f"k_{c}").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows.
    """
    return bpe.round_trip(docs, ranks_path(), with_ids=True)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_copies), ("PII", personal_data), ("mixing sources", mixture), ("byte-level BPE", tokens)]
#: The learned list, the fingerprints' hash, the recursive merges and the calibrated draw are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return docs
