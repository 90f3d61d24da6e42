import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import errors
from vecspark.config import Config
from vecspark.engine import Engine
from vecspark.evaluate import log_statistics, recall, sweep
from vecspark.operators.index import IndexSpec
from vecspark.plans.cache import LRUCache
from vecspark.plans.embedding import HashingProvider
from vecspark.plans.store import last_write, live, replay
from vecspark.sources import vectors as src
from vecspark.streaming.ingest import latest, upsert_stream


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def four(engine, **kw):
    engine.create_collection("c", 3, **kw)
    engine.upsert("c", engine.documents([{"id": i, "vector": [3 * i - 2.0, 3 * i - 1.0, 3.0 * i], "parameters": {"tag": f"t{i % 2}", "n": i}} for i in range(1, 5)]))
    return engine


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_catalogue(engine):
    assert engine.health() == {"status": "ok"}
    engine.create_collection("a", 3, "flat", metadata={"k": "v"})
    with pytest.raises(errors.CollectionExists):
        engine.create_collection("a", 3)
    engine.create_collection("a", 3, if_not_exists=True)
    engine.create_collection("b", 4, "ivf_flat", nlist="5", nprobe=2.0)
    assert sorted(r["name"] for r in engine.list_collections().collect()) == ["a", "b"]
    assert engine.get_collection("a")["metadata"] == {"k": "v"} and engine.spec("b").parameters == {"nlist": 5, "nprobe": 2}
    engine.drop_collection("a")
    for verb in (engine.get_collection, engine.drop_collection, engine.view):
        with pytest.raises(errors.CollectionNotFound):
            verb("a")
    with pytest.raises(errors.InvalidParameter):
        engine.create_collection("../x", 3)


def test_specs():
    for bad, kind in (((0,), errors.InvalidDimension), ((3, "tree"), errors.UnsupportedIndexType), ((3, "flat", "l7"), errors.InvalidParameter), ((3, "hnsw", "cos"), errors.FailedToCreateIndex), ((8, "ivfpq", "ip"), errors.FailedToCreateIndex), ((5, "ivfpq"), errors.InvalidDimension)):
        with pytest.raises(kind):
            IndexSpec.of(*bad)
    with pytest.raises(errors.InvalidParameter):
        IndexSpec.of(3, "flat", nlist=3)
    s = IndexSpec.of(8, "ivf_flat", nlist=5, nprobe=50)
    assert s.parameters["nprobe"] == 5 and s.with_params(nprobe=3).parameters["nprobe"] == 3 and IndexSpec.from_json(s.to_json()) == s
    for bad in ({"nprobe": 6}, {"nprobe": 0}, {"efsearch": 5}, {"nprobe": "x"}):
        with pytest.raises(errors.InvalidParameter):
            s.with_params(**bad)
    with pytest.raises(errors.EmptyParameter):
        s.with_params()
    assert IndexSpec.of(3).with_params(efsearch=64).parameters["efsearch"] == 64


def test_upsert_search_delete_reload(engine, spark):
    four(engine, index_type="hnsw")
    q = engine.queries([[1.1, 2.1, 3.1]])
    assert ids(engine.search_vectors("c", q, 2)) == ["1", "2"]
    assert len(ids(engine.search_vectors("c", q, 99))) == 4
    engine.delete("c", ["1"])
    assert "1" not in ids(engine.search_vectors("c", q, 4))
    with pytest.raises(errors.DocumentNotFound):
        engine.delete("c", ["1"])
    with pytest.raises(errors.DocumentNotFound):
        engine.get("c", ["1"], strict=True)
    engine.upsert("c", engine.documents([{"id": "2", "vector": [1, 2, 3], "parameters": {"new": True}}]))
    before = sorted(map(tuple, engine.view("c").collect()))
    engine.compact("c")
    again = Engine(spark, engine.root)
    assert sorted(map(tuple, again.view("c").collect())) == before and len(before) == 3
    assert ids(again.search_vectors("c", q, 1)) == ["2"]
    assert again.view("c", 0).count() == 4  # an older version stays readable


def test_bad_documents_change_nothing(engine):
    four(engine, index_type="flat")
    for bad in ([{"id": "9", "vector": [1.0]}], [{"id": "9", "vector": None}]):
        with pytest.raises(Exception, match=errors.InvalidDimension.message):
            engine.upsert("c", engine.documents(bad))
    with pytest.raises(errors.DocumentExists):
        engine.insert("c", engine.documents([{"id": "1", "vector": [1, 2, 3]}]))
    with pytest.raises(errors.MismatchedKeysAndValues):
        engine.from_parallel(["1"], [])
    assert engine.view("c").count() == 4
    with pytest.raises(Exception, match=errors.InvalidDimension.message):
        engine.search_vectors("c", engine.queries([[1.0]]), 1).collect()


def test_documents_filters_cache_and_strict(engine):
    four(engine, index_type="flat")
    q = engine.queries([[1, 2, 3]])
    hits = engine.search_documents("c", q, 2, {"tag": "t1"}).orderBy("rank").collect()
    assert [r["id"] for r in hits] == ["1", "3"] and hits[0]["parameters"] == '{"tag": "t1", "n": 1}'
    assert engine.search_documents("c", q, 2, {"tag": "none"}).count() == 0
    with pytest.raises(errors.NoResultsFound):
        engine.search_documents("c", q, 2, {"tag": "none"}, strict=True)
    first = engine.search_one("c", [1, 2, 3], 2)
    assert "other" not in first and engine.search_one("c", [1, 2, 3], 2)["other"] == "cache_hit"
    engine.delete("c", ["1"])
    assert engine.search_one("c", [1, 2, 3], 2)["ids"] == ["2", "3"]


@pytest.mark.parametrize("index_type,parameters", [("ivf_flat", {"nlist": 4, "nprobe": 4}), ("ivfpq", {"nlist": 4, "nprobe": 4, "m": 4}), ("hnsw", {}), ("flat", {})])
def test_build_then_change_each_index(engine, spark, index_type, parameters):
    engine.create_collection("v", 8, index_type, **parameters)
    docs = engine.documents([{"id": i, "vector": [float(i)] + [0.0] * 7} for i in range(20)])
    if "nlist" in parameters:
        with pytest.raises(errors.IndexNotFound):
            engine.search_vectors("v", engine.queries([[1.0] + [0.0] * 7]), 1)
    engine.build_index("v", docs)
    assert ids(engine.search_vectors("v", engine.queries([[5.2] + [0.0] * 7]), 2)) == ["5", "6"]
    engine.upsert("v", engine.documents([{"id": "100", "vector": [100.0] + [0.0] * 7}]))
    engine.delete("v", ["5"])
    again = Engine(spark, engine.root)
    assert ids(again.search_vectors("v", engine.queries([[99.0] + [0.0] * 7]), 1)) == ["100"]
    assert ids(again.search_vectors("v", engine.queries([[5.2] + [0.0] * 7]), 1)) == ["6"]
    assert again.explain_index("v")


def test_embedding(engine, spark, tmp_path):
    e = Engine(spark, engine.root, HashingProvider(16))
    e.create_collection("t", 16, "flat")
    e.upsert("t", e.documents([{"id": i, "parameters": {"embedding": True, "text": t}} for i, t in enumerate(("red apple pie", "blue sky", "green tree"))]))
    assert ids(e.search_documents("t", k=1, text=["apple pie"])) == ["0"]
    with pytest.raises(errors.EmptyParameter):
        e.search_documents("t")
    with pytest.raises(Exception, match="provider"):
        Engine(spark, engine.root).upsert("t", e.documents([{"id": 1, "parameters": {"embedding": True, "text": "x"}}]))


def test_log_verbs(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "z", False), ("a", 2, "y", True), ("b", 1, "p", False), ("b", 2, None, True)], "id string, seq long, v string, deleted boolean")
    assert {(r["id"], r["v"]) for r in last_write(log).collect()} == {("a", "z"), ("b", None)}
    assert [r["id"] for r in live(log).collect()] == ["a"]
    assert {(r["id"], r["seq"]) for r in replay(log).where("valid").collect()} == {("a", 3), ("b", 2)}
    again = last_write(last_write(log).unionByName(log))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, last_write(log).collect()), key=str)


def test_streams(engine, spark, tmp_path):
    engine.create_collection("s", 1, "flat")
    schema = "id string, vector array<float>, parameters string, deleted boolean, seq long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put([("a", [1.0], "{}", False, 1), ("a", [2.0], "{}", False, 2), ("b", [5.0], "{}", False, 1)])
    run = lambda: upsert_stream(engine, "s", spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/cp").awaitTermination()
    run()
    put([("b", None, None, True, 2), ("c", [7.0], "{}", False, 1)])
    run()
    assert {(r["id"], r["vector"][0]) for r in engine.view("s").collect()} == {("a", 2.0), ("c", 7.0)}
    spark.createDataFrame([("k", 2, "new", False), ("k", 1, "old", False), ("m", 1, "x", True)], "key string, seq long, value string, deleted boolean").write.parquet(f"file://{tmp_path}/log")
    source = spark.readStream.schema("key string, seq long, value string, deleted boolean").parquet(f"file://{tmp_path}/log")
    q = latest(source).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("newest").collect()} == {("k", 2, "new", False), ("m", 1, "x", True)}


def test_files(spark, tmp_path):
    x = np.arange(12, dtype="f4").reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in x))
    assert [r["vector"] for r in src.read_fvecs(spark, f"file://{tmp_path}/a.fvecs").orderBy("nr").collect()] == x.tolist()
    (tmp_path / "b.idx.gz").write_bytes(gzip.compress(struct.pack(">IIII", 2051, 2, 1, 2) + bytes([0, 255, 51, 102])))
    assert [r["vector"] for r in src.read_idx(spark, f"file://{tmp_path}/b.idx.gz").orderBy("nr").collect()] == [pytest.approx([0.0, 1.0]), pytest.approx([0.2, 0.4])]
    records = [(b"k", b"v" * 200), (b"", b"")]
    (tmp_path / "c.wal").write_bytes(src.frame_log(records))
    assert [(bytes(r["key"]), bytes(r["value"])) for r in src.read_log(spark, f"file://{tmp_path}/c.wal").orderBy("nr").collect()] == records
    for parse, data in ((src.parse_fvecs, b""), (src.parse_fvecs, b"\1\0\0\0"), (src.parse_idx, b"\0" * 16), (lambda d: list(src.parse_log(d)), b"\5\1a")):
        with pytest.raises(ValueError):
            parse(data)
    src.write_with_bloom(spark.range(100).withColumnRenamed("id", "k"), f"file://{tmp_path}/bloom", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/bloom").where("k = 7").count() == 1


def test_small_parts(spark, tmp_path):
    cache = LRUCache(2)
    for k in (1, 2):
        cache.set(k, k)
    cache.get(1)
    cache.set(3, 3)
    assert cache.get(2) is None and cache.get(1) == 1 and len(cache) == 2 and cache.delete(1) and not cache.delete(1)
    cache.set("ab", 1)
    assert cache.delete_prefix("a") == 1
    (tmp_path / "c.yaml").write_text('dir: "/x"  # comment\ncache_size: 3\nsst_size: 9\n')
    c = Config.from_file(tmp_path / "c.yaml")
    assert (c.dir, c.cache_size) == ("/x", 3)
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "query_id long, id long")
    assert {(r["query_id"], r["recall"]) for r in recall(truth.where("id < 2"), truth).collect()} == {(1, 0.5), (2, 0.0)}
    assert sweep({"all": lambda: truth}, truth, 2)[0]["recall"] == 1.0
    lines = spark.createDataFrame([("INFO x",), ("an Error",), ("?",)], "value string")
    assert {tuple(r) for r in log_statistics(lines).collect()} == {("INFO", 1), ("ERROR", 1), ("OTHER", 1)}


def test_codes_are_stored_and_builds_keep_the_last_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(str(i), [float(e) for e in rng.normal(size=8).astype("f4")], "{}") for i in range(60)]
    twice = [(i, [0.0] * 8, '{"old": 1}') for i, _, _ in rows[:20]] + rows
    e = Engine(spark, f"file://{tmp_path}/codes")
    e.create_collection("c", 8, "ivfpq", nlist=4, nprobe=4, m=4)
    e.build_index("c", spark.createDataFrame(twice, "id string, vector array<float>, parameters string").coalesce(1))
    assert {r["id"]: r["vector"] for r in e.view("c").collect()} == {i: v for i, v, _ in rows}
    assert e.store("c").view(codes=True).where("codes is null").count() == 0
    asked = e.queries([v for _, v, _ in rows[:5]])
    before = [tuple(r) for r in e.search_vectors("c", asked, 3).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in before if r[1] == 1] == [i for i, _, _ in rows[:5]]
    e.upsert("c", spark.createDataFrame([("new", rows[0][1], "{}")], "id string, vector array<float>, parameters string"))
    e.compact("c")
    stored = e.store("c").view(codes=True)
    assert stored.where("codes is null").count() == 1 and stored.count() == 61
    assert {r["id"] for r in e.search_vectors("c", asked.where("query_id = 0"), 2).collect()} == {"0", "new"}
