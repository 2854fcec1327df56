"""Tables written between stages of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder in local mode, and an error on a cluster, whose executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="veil-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing. freed: the write's shuffle files go as it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, str(freed or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete a table that written() gave, once nothing reads it any more."""
    for spark, path in list(_written):
        if path == df._veil_path:
            _written.remove((spark, path))
            _delete(spark, path)


def release() -> None:
    """Delete the tables written so far; results that still read them must have been consumed."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(release)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
