"""The query catalogue: name to callable, and name to the DuckDB SQL that gives the same rows.

Searches take as queries the vectors whose id is divisible by 50, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .evaluate import recall
from .functions import distance as dist
from .functions.filters import matches
from .functions.scalar import cache_key, doc_key, residual
from .operators import kmeans, scan, topk
from .operators.index import hnsw, ivf, ivfpq, lsh
from .plans.embedding import HashingProvider, embed
from .plans.store import last_write, live
from .plans.workspace import new_root
from .streaming.ingest import upsert_stream

K = 10
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SQL_DISTANCE = {
    "l2": "list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "ip": "0.0 - list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2]))",
    "cos": "1.0 - list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(qv, lambda x: x * x)) * list_sum(list_transform(v, lambda x: x * x)))",
    "hamming": "len(list_filter(list_zip(qv, v), lambda p: p[1] <> p[2]))::DOUBLE",
}
Q_SQL = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"
C_SQL = "c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def top_sql(space: str = "l2", where: str = "true", k: int = K, source: str = "c") -> str:
    return f"""WITH {Q_SQL}, {C_SQL}, p AS (SELECT query_id, id, {SQL_DISTANCE[space]} AS distance FROM q CROSS JOIN {source} WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM p)
    SELECT query_id, rank, id, distance FROM r WHERE rank <= {k}"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# exact search

for _space in SQL_DISTANCE:
    query(f"knn_{_space}", top_sql(_space))(lambda spark, d, s=_space: topk.knn(asked(spark, d), corpus(spark, d), K, s))

query("knn_bulk_l2", top_sql())(lambda spark, d: topk.knn(asked(spark, d), corpus(spark, d), K, bulk=True))
query("knn_prefilter_label", top_sql(where="label = 3"))(lambda spark, d: topk.knn(asked(spark, d), corpus(spark, d), K, filter=F.col("label") == 3))
query("range_search_l2", top_sql(where=f"{SQL_DISTANCE['l2']} <= 1.5", k=2**31 - 1))(lambda spark, d: topk.within(asked(spark, d), corpus(spark, d), 1.5))


@query(
    "knn_postfilter_overfetch",
    f"""WITH best AS ({top_sql(k=20)}), kept AS (SELECT query_id, best.id, distance FROM best JOIN embeddings ON vec_id = best.id WHERE label <> 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM kept) SELECT query_id, rank, id, distance FROM r WHERE rank <= {K}""",
)
def knn_postfilter(spark: SparkSession, d: str) -> DataFrame:
    return topk.knn_postfilter(asked(spark, d), corpus(spark, d), K, "l2", F.col("label") != 3)


@query(
    "knn_distinct_doc",
    f"""WITH {Q_SQL}, {C_SQL}, p AS (SELECT query_id, label AS doc, min({SQL_DISTANCE["l2"]}) AS distance FROM q CROSS JOIN c GROUP BY query_id, label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc)::INT AS rank FROM p) SELECT query_id, rank, doc, distance FROM r WHERE rank <= 5""",
)
def knn_distinct_doc(spark: SparkSession, d: str) -> DataFrame:
    return topk.knn_documents(asked(spark, d), corpus(spark, d).withColumnRenamed("label", "doc"), 5)


@query(
    "distance_stats",
    f"""WITH {Q_SQL}, {C_SQL} SELECT label, {", ".join(f"min({e}) AS min_{s}, max({e}) AS max_{s}, round(avg({e}), 9) AS avg_{s}" for s, e in SQL_DISTANCE.items())}
    FROM q CROSS JOIN c GROUP BY label""",
)
def distance_stats(spark: SparkSession, d: str) -> DataFrame:
    def folded(q: DataFrame, c: DataFrame) -> DataFrame:
        both = c.crossJoin(F.broadcast(q)).select("label", F.explode(F.create_map(*[e for s in SQL_DISTANCE for e in (F.lit(s), dist.distance(s, F.col("qvec"), F.col("vector")))])))
        return both.select("label", F.col("key").alias("space"), F.col("value").alias("distance"))

    each = scan.statistics(asked(spark, d), corpus(spark, d), "label", list(SQL_DISTANCE), folded)
    of = lambda f, column, s: f(F.when(F.col("space") == s, F.col(column)))
    mean = lambda s: F.round(F.try_divide(of(F.sum, "total", s), of(F.sum, "n", s)), 9)
    return each.groupBy("label").agg(*[e for s in SQL_DISTANCE for e in (of(F.min, "least", s).alias(f"min_{s}"), of(F.max, "most", s).alias(f"max_{s}"), mean(s).alias(f"avg_{s}"))])


@query("ip_hnsw_offset", f"""WITH {Q_SQL}, {C_SQL} SELECT query_id, id, 1.0 - list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS distance FROM q CROSS JOIN c""")
def ip_hnsw_offset(spark: SparkSession, d: str) -> DataFrame:
    def folded(q: DataFrame, c: DataFrame) -> DataFrame:
        return c.crossJoin(F.broadcast(q)).select("query_id", "id", dist.ip_hnsw(F.col("qvec"), F.col("vector")).alias("distance"))

    return scan.every(asked(spark, d), corpus(spark, d), 1.0, folded)


@query("search_vectors_projection", f"SELECT query_id, id, distance FROM ({top_sql()})")
def search_vectors_projection(spark: SparkSession, d: str) -> DataFrame:
    return topk.knn(asked(spark, d), corpus(spark, d), K).select("query_id", "id", "distance")


@query("search_documents_hydrated", f"SELECT t.query_id, t.rank, t.id, t.distance, lang, source, n_chars FROM ({top_sql()}) t JOIN documents ON doc_id = t.id")
def search_documents_hydrated(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return topk.hydrate(topk.knn(asked(spark, d), corpus(spark, d), K), docs).select("query_id", "rank", "id", "distance", "lang", "source", "n_chars")


# clustering and approximate search

NLIST, NPROBE = 8, 2
SEEDS_SQL = "s AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, embedding::DOUBLE[] AS v FROM embeddings QUALIFY cid < 8)"
ASSIGN_SQL = f"""a AS (SELECT id, c.v AS vector, cid FROM (SELECT c.id, c.v AS qv, s.v, cid FROM {"{c}"} CROSS JOIN s) x JOIN c USING (id)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY {SQL_DISTANCE["l2"].replace("qv", "x.qv").replace(" v)", " x.v)")}, cid) = 1)""".replace("{c}", "c")
PROBES_SQL = f"""f AS (SELECT query_id, qv, cid FROM (SELECT query_id, qv, cid, v FROM q CROSS JOIN s) x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {SQL_DISTANCE["l2"]}, cid) <= {NPROBE})"""


def seeded(spark: SparkSession, d: str) -> tuple[list[list[float]], DataFrame]:
    c = corpus(spark, d)
    centroids = kmeans.seeds(c, NLIST)
    return centroids, kmeans.assign(c, centroids)


@query("kmeans_assign_seed", f"WITH {C_SQL}, {SEEDS_SQL}, {ASSIGN_SQL} SELECT id, cid FROM a")
def kmeans_assign_seed(spark: SparkSession, d: str) -> DataFrame:
    return seeded(spark, d)[1].select("id", "cid")


@query(
    "kmeans_one_iter_centroids",
    f"""WITH {C_SQL}, {SEEDS_SQL}, {ASSIGN_SQL}, e AS (SELECT cid, id, unnest(vector) AS x, unnest(generate_series(1, len(vector))) - 1 AS pos FROM a)
    SELECT cid, pos::INT AS pos, list_sum(list(x ORDER BY id)) / count(*) AS value FROM e GROUP BY cid, pos""",
)
def kmeans_one_iter_centroids(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.ordered_means(seeded(spark, d)[1])


IVF_SQL = f"""WITH {Q_SQL}, {C_SQL}, {SEEDS_SQL}, {ASSIGN_SQL}, {PROBES_SQL}, p AS (SELECT query_id, id, {SQL_DISTANCE["l2"].replace(" v)", " vector)")} AS distance FROM f JOIN a USING (cid)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM p) SELECT query_id, rank, id, distance FROM r WHERE rank <= {K}"""


@query("ivf_search_seed_nprobe2", IVF_SQL)
def ivf_search_seed(spark: SparkSession, d: str) -> DataFrame:
    centroids, lists = seeded(spark, d)
    return ivf.search(asked(spark, d), lists, centroids, NPROBE, K)


@query("ivf_full_probe_equals_flat", top_sql())
def ivf_full_probe(spark: SparkSession, d: str) -> DataFrame:
    centroids, lists = seeded(spark, d)
    return ivf.search(asked(spark, d), lists, centroids, NLIST, K)


@query("recall_at_10_ivf", f"WITH t AS ({top_sql()}), g AS ({IVF_SQL}) SELECT t.query_id, count(g.id) AS hits, count(*) AS expected, count(g.id) / count(*) AS recall FROM t LEFT JOIN g ON t.query_id = g.query_id AND t.id = g.id GROUP BY t.query_id")
def recall_at_10_ivf(spark: SparkSession, d: str) -> DataFrame:
    return recall(ivf_search_seed(spark, d), topk.knn(asked(spark, d), corpus(spark, d), K))


PQ_M, PQ_CODES = 8, 16
RESIDUAL_SQL = "res AS (SELECT a.id, a.cid, list_transform(list_zip(a.vector, s.v), lambda p: p[1] - p[2]) AS r FROM a JOIN s USING (cid))"
CODES_SQL = f"""subs AS (SELECT unnest(range({PQ_M}))::INT AS sub), width AS (SELECT any_value(len(r)) // {PQ_M} AS w FROM res),
    books AS (SELECT sub, code, r[sub * w + 1 : sub * w + w] AS v FROM (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS code, r FROM res QUALIFY code < {PQ_CODES}) CROSS JOIN subs CROSS JOIN width),
    parts AS (SELECT id, cid, sub, r[sub * w + 1 : sub * w + w] AS qv FROM res CROSS JOIN subs CROSS JOIN width),
    enc AS (SELECT id, cid, sub, code FROM parts JOIN books USING (sub) QUALIFY row_number() OVER (PARTITION BY id, sub ORDER BY {SQL_DISTANCE["l2"]}, code) = 1)"""


def pq_seeded(spark: SparkSession, d: str) -> tuple[list, list, DataFrame]:
    centroids, lists = seeded(spark, d)
    res = lists.join(F.broadcast(ivf.centroid_frame(lists, centroids)), "cid").select("id", residual(F.col("vector"), F.col("centroid")).alias("r"))
    first = [r[0] for r in res.orderBy("id").select("r").limit(PQ_CODES).collect()]
    width = len(first[0]) // PQ_M
    books = [[list(r[j * width : (j + 1) * width]) for r in first] for j in range(PQ_M)]
    return centroids, books, ivfpq.encode(lists, centroids, books)


@query("pq_encode_seed", f"WITH {C_SQL}, {SEEDS_SQL}, {ASSIGN_SQL}, {RESIDUAL_SQL}, {CODES_SQL} SELECT id, cid, sub, code FROM enc")
def pq_encode_seed(spark: SparkSession, d: str) -> DataFrame:
    return pq_seeded(spark, d)[2].select("id", "cid", F.posexplode("codes").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


@query(
    "pq_adc_search",
    f"""WITH {Q_SQL}, {C_SQL}, {SEEDS_SQL}, {ASSIGN_SQL}, {PROBES_SQL}, {RESIDUAL_SQL}, {CODES_SQL},
    qr AS (SELECT query_id, cid, list_transform(list_zip(qv, s.v), lambda p: p[1] - p[2]) AS r FROM f JOIN s USING (cid)),
    qp AS (SELECT query_id, cid, sub, r[sub * w + 1 : sub * w + w] AS qv FROM qr CROSS JOIN subs CROSS JOIN width),
    t AS (SELECT query_id, cid, sub, code, {SQL_DISTANCE["l2"]} AS d FROM qp JOIN books USING (sub)),
    p AS (SELECT query_id, id, list_sum(list(d ORDER BY sub)) AS distance FROM enc JOIN t USING (cid, sub, code) GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM p) SELECT query_id, rank, id, distance FROM r WHERE rank <= {K}""",
)
def pq_adc_search(spark: SparkSession, d: str) -> DataFrame:
    centroids, books, encoded = pq_seeded(spark, d)
    return ivfpq.search(asked(spark, d), encoded, centroids, books, NPROBE, K)


@query("ivf_trained_search")
def ivf_trained_search(spark: SparkSession, d: str) -> DataFrame:
    centroids, lists = ivf.build(corpus(spark, d), NLIST)
    return ivf.search(asked(spark, d), lists, centroids, 7, K)


@query("ivfpq_trained_search")
def ivfpq_trained_search(spark: SparkSession, d: str) -> DataFrame:
    centroids, books, encoded = ivfpq.build(corpus(spark, d), NLIST, PQ_M)
    return ivfpq.search(asked(spark, d), encoded, centroids, books, NLIST, K)


@query("ivfpq_rerank_search")
def ivfpq_rerank_search(spark: SparkSession, d: str) -> DataFrame:
    centroids, books, encoded = ivfpq.build(corpus(spark, d), NLIST, PQ_M)
    return ivfpq.search(asked(spark, d), encoded, centroids, books, NLIST, K, rerank=10)


@query("hnsw_graph_search")
def hnsw_graph_search(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.search(asked(spark, d), hnsw.build(corpus(spark, d)), K, 100)


@query("lsh_search")
def lsh_search(spark: SparkSession, d: str) -> DataFrame:
    return lsh.search(asked(spark, d), corpus(spark, d), K, radius=1.3)


# engine verbs

NO_LABEL_7 = top_sql(where="label <> 7")


def _engine(spark: SparkSession, d: str, index_type: str, **parameters) -> Engine:
    e = Engine(spark, new_root(spark, "collections"))
    e.create_collection("vectors", 64, index_type, **parameters)
    return e


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("parameters"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", F.col("id").cast("long").alias("id"), "distance")


TEXT_TOP = top_sql().replace("ORDER BY distance, id", "ORDER BY distance, id::VARCHAR")


@query("engine_flat_search", TEXT_TOP)
def engine_flat_search(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, "flat")
    e.upsert("vectors", _docs(spark, d))
    return _hits(e.search_vectors("vectors", asked(spark, d), K))


@query("engine_delete_compact_search", NO_LABEL_7.replace("ORDER BY distance, id", "ORDER BY distance, id::VARCHAR"))
def engine_delete_compact_search(spark: SparkSession, d: str) -> DataFrame:
    e, docs = _engine(spark, d, "flat"), _docs(spark, d)
    e.upsert("vectors", docs)
    e.delete("vectors", docs.where(matches({"label": 7})).select("id"))
    e.compact("vectors")
    return _hits(e.search_vectors("vectors", asked(spark, d), K))


@query("engine_filtered_documents", f"SELECT query_id, rank, t.id, distance, label FROM ({top_sql(where='label = 3').replace('ORDER BY distance, id', 'ORDER BY distance, id::VARCHAR')}) t JOIN embeddings ON vec_id = t.id")
def engine_filtered_documents(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, "flat")
    e.upsert("vectors", _docs(spark, d))
    hits = e.search_documents("vectors", asked(spark, d), K, {"label": 3})
    return hits.select("query_id", "rank", F.col("id").cast("long").alias("id"), "distance", F.get_json_object("parameters", "$.label").cast("int").alias("label"))


@query("engine_ivf_full_probe", TEXT_TOP)
def engine_ivf_full_probe(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, "ivf_flat", nlist=NLIST, nprobe=NLIST)
    e.build_index("vectors", _docs(spark, d), max_iter=5)
    return _hits(e.search_vectors("vectors", asked(spark, d), K))


@query("hnsw_exact_contract", TEXT_TOP)
def hnsw_exact_contract(spark: SparkSession, d: str) -> DataFrame:
    """A graph that later writes have made stale: the search answers exactly, with the new rows."""
    e, docs = _engine(spark, d, "hnsw"), _docs(spark, d)
    e.build_index("vectors", docs.where("cast(id AS long) % 2 = 0"))
    e.upsert("vectors", docs.where("cast(id AS long) % 2 = 1"))
    return _hits(e.search_vectors("vectors", asked(spark, d), K))


@query("list_collections", "SELECT 'label_' || label AS name, 64 AS dimension, 'flat' AS index_type, 'l2' AS space FROM embeddings GROUP BY label")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, new_root(spark, "collections"))
    for r in read(spark, d, "embeddings").select("label").distinct().collect():  # one collection a label
        e.create_collection(f"label_{r['label']}", 64, "flat")
    return e.list_collections().drop("metadata")


@query("collection_counts", "SELECT 'label_' || label AS name, count(*) AS n FROM embeddings GROUP BY label")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """The live documents of each collection of an engine, one collection a label."""
    e, docs, out = Engine(spark, new_root(spark, "collections")), _docs(spark, d), None
    for r in read(spark, d, "embeddings").select("label").distinct().orderBy("label").collect():
        name = f"label_{r['label']}"
        e.create_collection(name, 64, "flat")
        e.upsert(name, docs.where(matches({"label": r["label"]})))
        counted = e.view(name).groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


# op-log: events as writes to users, errors as tombstones


def _log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


NEWEST_SQL = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
LIVE_SQL = f"SELECT * FROM ({NEWEST_SQL}) WHERE event_type <> 'error'"


@query("upsert_lww", NEWEST_SQL)
def upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    return last_write(_log(spark, d), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("get_documents", LIVE_SQL)
def get_documents(spark: SparkSession, d: str) -> DataFrame:
    return live(_log(spark, d), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("delete_documents", "SELECT vec_id AS id, label FROM embeddings WHERE label <> 7 AND vec_id % 3 <> 0")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """Two deletes from a collection, the second one with ids that the first has taken already."""
    e, docs = _engine(spark, d, "flat"), _docs(spark, d)
    e.upsert("vectors", docs)
    e.delete("vectors", docs.where(matches({"label": 7})).select("id"))
    e.delete("vectors", docs.where("cast(id AS long) % 3 = 0").select("id"), strict=False)
    return e.view("vectors").select(F.col("id").cast("long").alias("id"), F.get_json_object("parameters", "$.label").cast("int").alias("label"))


@query("compact_levels", NEWEST_SQL)
def compact_levels(spark: SparkSession, d: str) -> DataFrame:
    log, order = _log(spark, d), ("ts", "event_id")
    levels = [last_write(log.where(F.col("event_id") % 4 == n), "user_id", order) for n in range(4)]
    merged = levels[0]
    for x in levels[1:]:
        merged = merged.unionByName(x)
    return last_write(merged, "user_id", order).select("user_id", "event_id", "event_type", "value")


@query("stream_upsert_final_state", LIVE_SQL.replace("user_id, event_id, event_type, value FROM", "user_id, event_id, event_type, value FROM"))
def stream_upsert_final_state(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of upserts into a collection, run to the end of the input."""
    root = new_root(spark, "stream")
    e = Engine(spark, f"{root}/collections")
    e.create_collection("users", 1, "flat")
    schema = read(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    log = events.select(
        F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), F.to_json(F.struct("user_id", "event_id", "event_type", "value")).alias("parameters"),
        (F.col("event_type") == "error").alias("deleted"), F.struct("ts", "event_id").alias("seq"),
    )
    upsert_stream(e, "users", log, f"{root}/checkpoint").awaitTermination()
    return e.view("users").select(F.from_json("parameters", "user_id long, event_id long, event_type string, value double").alias("p")).select("p.*")


# filters, look-ups and scalar functions


@query("json_filter_props", "SELECT event_id, user_id, props FROM events WHERE json_extract(props, '$.k')::BIGINT = 3")
def json_filter_props(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(matches({"k": 3}, "props")).select("event_id", "user_id", "props")


@query("point_get", "SELECT vec_id AS id, label, 64 AS dimension FROM embeddings WHERE vec_id % 50 = 0")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a collection by id, after half of them were written twice."""
    e, docs = _engine(spark, d, "flat"), _docs(spark, d)
    e.upsert("vectors", docs.withColumn("parameters", F.lit("{}")))
    e.upsert("vectors", docs)
    found = e.get("vectors", docs.where("cast(id AS long) % 50 = 0").select("id"))
    return found.select(F.col("id").cast("long").alias("id"), F.get_json_object("parameters", "$.label").cast("int").alias("label"), "dimension")


@query("cache_key_sha256", "SELECT doc_id, sha256(concat_ws(':', source, '[' || n_chars || ']', '10')) AS key FROM documents")
def cache_key_sha256(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", cache_key(F.col("source"), F.array("n_chars"), F.lit(10)).alias("key"))


@query("document_keys", "SELECT doc_id, 'doc:' || source || ':' || doc_id AS key FROM documents")
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", doc_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"))


@query("embed_documents_search")
def embed_documents_search(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts embedded by the hashing provider, then searched by the ones whose id is divisible by 50."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), embed(F.col("text"), HashingProvider(64)).alias("vector"))
    return topk.knn(docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec")), docs, K, "cos", bulk=True)


@query("conversations_distinct")
def conversations_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Nearest conversations of each benchmark text, by their nearest turn."""
    turns = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("doc"), embed(F.col("text"), HashingProvider(32)).alias("vector"))
    items = read(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), embed(F.col("text"), HashingProvider(32)).alias("qvec"))
    return topk.knn_documents(items, turns, 5, "cos")


