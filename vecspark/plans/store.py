"""Versioned collection storage: an op-log of Parquet deltas over a compacted base, read as last write wins.

A version is a small manifest, written whole and then renamed into place, that names its base and its deltas; readers
see the greatest version only. The base has one row per live document; deltas have sequence numbers and tombstones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("id", "vector", "parameters")
LOG = "id string, vector array<float>, parameters string, cid int, seq long, nr long, deleted boolean"


def last_write(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest row of each key, tombstones included: max_by combines in each task, so a hot key is one row a task."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select(key, "_row.*")


def live(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",), deleted: str = "deleted") -> DataFrame:
    return last_write(log, key, order).where(~F.col(deleted))


def replay(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Every state a key went through, with ``valid`` marking the last one."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("valid", F.row_number().over(w) == 1)


class Files:
    """The few file operations that Spark's readers and writers lack, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, p: str) -> list[str]:
        at = self.path(p)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, p: str, text: str) -> bool:
        """Write a file that must not exist yet, whole or not at all; False if it does."""
        if self.fs.exists(self.path(p)):
            return False
        hidden = self.path(f"{p}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return bool(self.fs.rename(hidden, self.path(p)))

    def delete(self, p: str) -> bool:
        return bool(self.fs.delete(self.path(p), True))


class Store:
    """Documents of one collection below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)

    def version(self) -> int:
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        return max((int(n[:-5]) for n in names), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.root}/versions/{v:012d}.json")) if v >= 0 else {"base": None, "deltas": [], "state": {}}

    def commit(self, manifest: dict) -> int:
        """Make a manifest the next version; fails if another writer was first."""
        v = self.version() + 1
        if not self.files.put_new(f"{self.root}/versions/{v:012d}.json", json.dumps(manifest)):
            raise RuntimeError(f"version {v} of {self.root} was written by another writer")
        return v

    def _new(self, name: str) -> str:
        return f"{self.root}/data/{name}-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame, state: dict | None = None) -> int:
        """Add ``rows(id, vector, parameters, cid, deleted)`` as one delta; of equal ids in it the last row counts.

        ``state`` replaces the state in the same version, so that both are there or neither is.
        """
        now, path = self.manifest(), self._new("delta")
        seq = F.lit(self.version() + 1).cast("long")
        rows.select("id", F.col("vector").cast("array<float>"), "parameters", F.col("cid").cast("int"), seq.alias("seq"), F.monotonically_increasing_id().alias("nr"), "deleted").write.parquet(path)
        return self.commit(now | {"deltas": [*now["deltas"], path]} | ({} if state is None else {"state": state}))

    def replace(self, rows: DataFrame, state: dict | None = None, by_list: bool = False) -> int:
        """A new base of ``rows(id, vector, parameters, cid)``; stored by cid if it has inverted lists."""
        path, now = self._new("base"), self.manifest()
        out = rows.select("id", F.col("vector").cast("array<float>"), "parameters", *[c for c in rows.columns if c not in COLUMNS])
        (out.repartition("cid").write.partitionBy("cid") if by_list else out.write).parquet(path)
        return self.commit({"base": path, "deltas": [], "state": now["state"] if state is None else state})

    def changes(self, manifest: dict | None = None) -> DataFrame | None:
        m = manifest or self.manifest()
        return last_write(self.spark.read.schema(LOG).parquet(*m["deltas"]), "id", ("seq", "nr")) if m["deltas"] else None

    def view(self, version: int | None = None, codes: bool = False) -> DataFrame:
        """``id, vector, parameters, cid`` of live documents: the base less what deltas touch, and what they leave.

        ``codes`` adds the codes that the base was stored with (null for what came after).
        """
        columns = ["id", "vector", "parameters", "cid", *["codes"] * codes]
        m = self.manifest(version)
        empty = self.spark.createDataFrame([], "id string, vector array<float>, parameters string, cid int")
        base = self.spark.read.parquet(m["base"]) if m["base"] else empty
        base = base if "cid" in base.columns else base.withColumn("cid", F.lit(None).cast("int"))
        base = base if "codes" in base.columns else base.withColumn("codes", F.lit(None).cast("array<int>"))
        base = base.withColumn("cid", F.col("cid").cast("int")).select(columns)
        changed = self.changes(m)
        if changed is None:
            return base
        return base.join(changed.select("id"), "id", "left_anti").unionByName(changed.where(~F.col("deleted")).withColumn("codes", F.lit(None).cast("array<int>")).select(columns))

    def compact(self) -> int:
        """Fold deltas into a new base; tombstones go. The view is the same before and after."""
        m = self.manifest()
        return self.replace(self.view(codes=bool(m["state"].get("books"))), m["state"], by_list=bool(m["state"].get("centroids")))
