"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster is refused
    one, since its executors wouldn't share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read again: its work isn't repeated, and a lost executor loses nothing.

    ``by`` is an integer column whose values get a folder each, so that a filter on it reads only its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = df.write.option("compression", "zstd")
    # a written table's shuffles are done with: Spark keeps their files otherwise until the driver collects its garbage
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    paths, files = _WRITTEN.get(spark.sparkContext.applicationId, []), df.inputFiles()
    for path in [p for p in paths if any(p.rpartition("/")[2] in f.split("/") for f in files)]:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        paths.remove(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that this application has written so far, once their results are stored; gives their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return len(paths)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables stored as ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
