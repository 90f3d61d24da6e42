"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lm, mixing, privacy, rules, simhash, suffixes, vectors, warc
from .tables import table


#: Wanted shares of tokens. The first source is hot in some tables and is held down, three others are doubled or so. The
#: table has no topic labels; the form of a text (mixing.form) stands for one.
TARGETS = {
    "source": {"src0": 0.1, "src1": 0.06, "src2": 0.06, "src3": 0.06, "*": 0.72},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"tabular": 0.04, "note": 0.02, "article": 0.5, "long": 0.44},
}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, {"topic": mixing.form()})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), ranks_path())


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.find(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages"))
    return back.select(back["record_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, {"reply": chat.REPLY})


def ranks_path() -> str:
    """Where the installed public vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks_path())


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10 over all embeddings and a disturbed copy of each: a check with links, cosines from 0.9 to 0.99."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    noise = lambda x, i: x + ((F.col("vec_id") * 31 + i * 17) % 11 - 5).cast("double") * (1 + F.col("vec_id") % 4) / 200.0
    copies = v.withColumn("embedding", F.transform("embedding", noise)).withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return vectors.near_duplicates(v.unionByName(copies))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_rules": op3_rules,
    "op4_suffixes": op4_suffixes,
    "op5_lm": op5_lm,
    "op6_privacy": op6_privacy,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_vectors": op10_vectors,
    "planted_vectors": planted_vectors,
}
#: Base32 by hand: each ten hexadecimal digits of the SHA-1 are eight digits of five bits.
BASE32_SQL = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '')"

ORACLE: dict[str, str] = {
    "op7_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
    f AS (SELECT hexed, min(page_id) AS original FROM p GROUP BY hexed)
    SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest,
    CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
    FROM p JOIN f USING (hexed)""",
    "op10_vectors": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    ok AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.95),
    reach(u, v) AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u)
    SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = v.vec_id), v.vec_id)) AS component_id,
    v.vec_id = least(v.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = v.vec_id), v.vec_id)) AS kept FROM v""",
}
ORACLE["planted_vectors"] = ORACLE["op10_vectors"].replace(
    "v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)",
    "e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT * FROM e UNION ALL SELECT vec_id + 1000000000, list_transform(x, lambda a, i: a + ((vec_id * 31 + (i - 1) * 17) % 11 - 5)::DOUBLE * (1 + vec_id % 4) / 200.0) FROM e)",
)
