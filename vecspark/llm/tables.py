"""Shared-folder tables that cut lineage, and small column helpers.

Every intermediate is an ordinary Parquet table in the folder named by ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and not a recomputation of the plan that made it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of everything but space and the five ASCII controls tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark removes an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode (tests) without one, a folder of this process; elsewhere an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="vecspark-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")  # the shuffle files behind a written table are of no more use
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut`, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound an Arrow batch's rows, so that a batch of very long texts still fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), as an array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{GAP}|{GAP}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))
