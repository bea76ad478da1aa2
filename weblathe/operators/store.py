"""Keeping intermediate tables where all executors see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A folder of files gets no side files of checksums, and a task no process to set the modes of each: Parquet has its own lengths and footers.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir was given. Without one, a folder of this process on a local master, as in tests; on a cluster
    that would lose rows, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = given.get()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kept-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def keep(df: DataFrame, path: str) -> None:
    """Writes df, until the application ends."""
    spark = df.sparkSession
    (df.write.options(**PLAIN) if path.startswith(("file:", "/")) else df.write).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there, and losing an executor loses nothing."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    keep(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
