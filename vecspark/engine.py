"""The engine: collections of documents with vectors, on versioned Parquet, searched through DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import CollectionExists, CollectionNotFound, DocumentExists, DocumentNotFound, EmptyParameter, IndexNotFound, InvalidDimension, InvalidParameter, MismatchedKeysAndValues, NoResultsFound
from .functions.filters import matches
from .operators import kmeans, topk
from .operators.index import IndexSpec, hnsw, ivf, ivfpq
from .plans.cache import LRUCache
from .plans.embedding import Provider, auto_embed, embed
from .plans.store import Files, Store, last_write

DOCUMENT = "id string, vector array<float>, parameters string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None, config: Config | None = None):
        self.spark, self.root, self.provider = spark, root.rstrip("/"), provider
        self.config = config or Config(root)
        self.files, self.cache = Files(spark, root), LRUCache(self.config.cache_size)

    # collections

    def health(self) -> dict:
        return {"status": "ok"}

    def _meta(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name or ""):
            raise InvalidParameter(f"collection name {name!r}")
        return f"{self.root}/{name}/collection.json"

    def create_collection(self, name: str, dimension: int, index_type: str = "hnsw", space: str = "l2", metadata: dict[str, str] | None = None, if_not_exists: bool = False, **parameters) -> dict:
        spec = IndexSpec.of(dimension, index_type, space, **parameters)
        row = {"name": name, "dimension": dimension, "index_type": index_type, "space": space, "metadata": metadata or {}, "spec": spec.to_json()}
        if not self.files.put_new(self._meta(name), json.dumps(row)):
            if not if_not_exists:
                raise CollectionExists(name)
        return self.get_collection(name)

    def get_collection(self, name: str) -> dict:
        try:
            return json.loads(self.files.read(self._meta(name)))
        except InvalidParameter:
            raise
        except Exception as e:
            if "FileNotFound" in str(e):
                raise CollectionNotFound(name) from None
            raise

    def list_collections(self) -> DataFrame:
        names = [n for n in self.files.names(self.root) if self.files.fs.exists(self.files.path(f"{self.root}/{n}/collection.json"))]
        rows = [(r["name"], r["dimension"], r["index_type"], r["space"], r["metadata"]) for r in map(self.get_collection, names)]
        return self.spark.createDataFrame(rows, "name string, dimension int, index_type string, space string, metadata map<string,string>")

    def drop_collection(self, name: str) -> None:
        """The collection with its documents and indexes."""
        self.get_collection(name)
        self.files.delete(f"{self.root}/{name}")

    def store(self, name: str) -> Store:
        self.get_collection(name)
        return Store(self.spark, f"{self.root}/{name}")

    def spec(self, name: str) -> IndexSpec:
        changed = self.store(name).manifest()["state"].get("spec")
        return IndexSpec.from_json(changed or self.get_collection(name)["spec"])

    def set_params(self, name: str, **parameters) -> IndexSpec:
        """Change nprobe or efsearch."""
        spec, store = self.spec(name).with_params(**parameters), self.store(name)
        m = store.manifest()
        store.commit(m | {"state": m["state"] | {"spec": spec.to_json()}})
        return spec

    # documents

    def documents(self, rows: list[dict]) -> DataFrame:
        """Rows of id, vector and a dictionary of parameters, as a DataFrame that the other verbs take."""
        out = [(str(r["id"]), [float(x) for x in r.get("vector") or []] or None, json.dumps(r.get("parameters") or {})) for r in rows]
        return self.spark.createDataFrame(out, DOCUMENT)

    def from_parallel(self, ids: list, vectors: list, parameters: list | None = None) -> DataFrame:
        if len(ids) != len(vectors) or parameters is not None and len(parameters) != len(ids):
            raise MismatchedKeysAndValues(f"{len(ids)} ids, {len(vectors)} vectors")
        return self.documents([{"id": i, "vector": v, "parameters": p} for i, v, p in zip(ids, vectors, parameters or [None] * len(ids))])

    def _ready(self, name: str, docs: DataFrame) -> DataFrame:
        have = docs.columns
        docs = docs.select(F.col("id").cast("string"), F.col("vector").cast("array<float>"), (F.col("parameters").cast("string") if "parameters" in have else F.lit("{}")).alias("parameters"))
        dim = self.get_collection(name)["dimension"]
        return topk.check_dimension(auto_embed(docs, self.provider), dim).where(F.when(F.col("id").isNotNull(), True).otherwise(F.raise_error(F.lit("a document needs an id")).cast("boolean")))

    def upsert(self, name: str, docs: DataFrame) -> int:
        """Last write wins; all rows or none: a bad row fails the write before the version that would name it."""
        store, spec = self.store(name), self.spec(name)
        rows, state = self._ready(name, docs), store.manifest()["state"]
        rows = kmeans.assign(rows, state["centroids"], spec.space) if state.get("centroids") else rows.withColumn("cid", F.lit(None).cast("int"))
        v = store.append(rows.withColumn("deleted", F.lit(False)))
        if self.config.compact_after and len(store.manifest()["deltas"]) > self.config.compact_after:
            v = self.compact(name)
        return v

    def insert(self, name: str, docs: DataFrame) -> int:
        """Upsert that refuses ids which exist, or occur twice."""
        ids = docs.select(F.col("id").cast("string").alias("id"))
        twice = ids.groupBy("id").count().where("count > 1").select("id")
        clash = self.store(name).view().select("id").join(ids, "id", "left_semi").unionByName(twice).limit(1).collect()
        if clash:
            raise DocumentExists(clash[0]["id"])
        return self.upsert(name, docs)

    def delete(self, name: str, ids: DataFrame | list, strict: bool = True) -> int:
        """Tombstones for ids; ``strict`` refuses ids that are missing."""
        ids = self.spark.createDataFrame([(str(i),) for i in ids], "id string") if isinstance(ids, list) else ids.select(F.col("id").cast("string"))
        store = self.store(name)
        if strict and (lost := ids.join(store.view().select("id"), "id", "left_anti").limit(1).collect()):
            raise DocumentNotFound(lost[0]["id"])
        return store.append(ids.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("parameters"), F.lit(None).cast("int").alias("cid"), F.lit(True).alias("deleted")))

    def get(self, name: str, ids: DataFrame | list, strict: bool = False) -> DataFrame:
        docs = self.view(name)
        if isinstance(ids, list):
            found = docs.where(F.col("id").isin([str(i) for i in ids]))
            if strict and found.count() < len({str(i) for i in ids}):
                raise DocumentNotFound(str(ids))
            return found
        return docs.join(ids.select(F.col("id").cast("string")), "id", "left_semi")

    def view(self, name: str, version: int | None = None) -> DataFrame:
        """``id, vector, parameters, dimension`` of the live documents."""
        return self.store(name).view(version).select("id", "vector", "parameters", F.size("vector").alias("dimension"))

    def compact(self, name: str) -> int:
        return self.store(name).compact()

    # indexes

    def build_index(self, name: str, docs: DataFrame | None = None, max_iter: int = 40) -> int:
        """Replace the contents with ``docs`` if given (of equal ids the last row), train, and store the rows the way the
        index type reads them."""
        store, spec = self.store(name), self.spec(name)
        rows = store.view().drop("cid") if docs is None else last_write(self._ready(name, docs).withColumn("nr", F.monotonically_increasing_id()), "id", ("nr",)).drop("nr")
        p, state = spec.parameters, {"spec": spec.to_json(), "trained": True}
        if spec.index_type == "ivf_flat":
            centroids, lists = ivf.build(rows, p["nlist"], spec.space, max_iter)
            return store.replace(lists, state | {"centroids": centroids}, by_list=True)
        if spec.index_type == "ivfpq":
            centroids, books, lists = ivfpq.build(rows, p["nlist"], p["m"], max_iter)
            return store.replace(lists, state | {"centroids": centroids, "books": books}, by_list=True)
        if spec.index_type == "hnsw":
            path = store._new("graph")
            v = store.replace(rows)
            hnsw.build(store.view(), p["M"], p["efConstruction"], spec.space).write.parquet(path)
            return store.commit(store.manifest() | {"state": state | {"graph": path, "graph_base": v}})
        return store.replace(rows, state)

    def _graph(self, store: Store) -> DataFrame | None:
        m = store.manifest()
        fresh = m["state"].get("graph") and m["base"] == store.manifest(m["state"]["graph_base"])["base"] and not m["deltas"]
        return self.spark.read.parquet(m["state"]["graph"]) if fresh else None

    def explain_index(self, name: str) -> str:
        """How a search will run."""
        store, spec = self.store(name), self.spec(name)
        if spec.index_type == "hnsw":
            return "graph shards" if self._graph(store) is not None else "exact scan: no graph of the current version"
        if spec.index_type in ("ivf_flat", "ivfpq"):
            return f"{spec.index_type}: {spec.parameters['nprobe']} of {spec.parameters['nlist']} lists" if store.manifest()["state"].get("trained") else "not trained"
        return "exact scan"

    # search

    def queries(self, vectors: list[list[float]]) -> DataFrame:
        return self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, qvec array<float>")

    def search_vectors(self, name: str, queries: DataFrame, k: int, filter: dict | None = None) -> DataFrame:
        """``query_id, rank, id, distance`` for ``queries(query_id, qvec)``; min(k, candidates) rows a query."""
        store, spec = self.store(name), self.spec(name)
        q = topk.check_dimension(queries, spec.dimension, "qvec")
        state, docs = store.manifest()["state"], store.view()
        if filter:
            docs = docs.where(matches(filter))
        p = spec.parameters
        if spec.index_type in ("ivf_flat", "ivfpq"):
            if not state.get("trained"):
                raise IndexNotFound(f"{name}: index not trained")
            if spec.index_type == "ivf_flat":
                return ivf.search(q, docs, state["centroids"], p["nprobe"], k, spec.space)
            docs = store.view(codes=True)
            docs = docs.where(matches(filter)) if filter else docs
            fresh = ivfpq.encode(docs.where("codes is null").drop("codes"), state["centroids"], state["books"])  # written after the build
            coded = docs.where("codes is not null").select("id", "cid", "vector", "codes").unionByName(fresh.select("id", "cid", "vector", "codes"))
            return ivfpq.search(q, coded, state["centroids"], state["books"], p["nprobe"], k)
        graph = self._graph(store) if spec.index_type == "hnsw" and not filter else None
        if graph is not None:
            return hnsw.search(q, graph, k, max(p["efsearch"], k), spec.space)
        return topk.knn(q, docs, k, spec.space)

    def search_one(self, name: str, vector: list[float], k: int) -> dict:
        """``ids`` and ``distances`` of one query, from the cache if the collection has not changed since."""
        dim = self.get_collection(name)["dimension"]
        if len(vector) != dim:
            raise InvalidDimension(f"{len(vector)}; expected {dim}")
        key = (name, self.store(name).version(), tuple(vector), k)
        if hit := self.cache.get(key):
            return hit | {"other": "cache_hit"}
        rows = self.search_vectors(name, self.queries([vector]), k).orderBy("rank").collect()
        out = {"ids": [r["id"] for r in rows], "distances": [r["distance"] for r in rows]}
        self.cache.set(key, out)
        return out

    def search_documents(self, name: str, queries: DataFrame | None = None, k: int = 10, filter: dict | None = None, text: list[str] | None = None, strict: bool = False) -> DataFrame:
        """Hits with their documents. ``text`` embeds queries with the provider; ``strict`` refuses an empty answer."""
        if queries is None:
            if not text:
                raise EmptyParameter("queries or text")
            asked = self.spark.createDataFrame(list(enumerate(text)), "query_id long, text string")
            queries = asked.select("query_id", embed(F.col("text"), self.provider).alias("qvec"))
        hits = topk.hydrate(self.search_vectors(name, queries, k, filter), self.view(name))
        if strict and not hits.limit(1).count():
            raise NoResultsFound(name)
        return hits.select("query_id", "rank", "id", "distance", "vector", "parameters", "dimension")
