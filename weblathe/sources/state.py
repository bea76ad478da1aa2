"""The tables of a mirror on disk, as Parquet under .state.

Most of them are logs: each run, wave or batch of a stream appends a part, and what holds now is found from the parts. A part that is written again, after a
failure, takes the place of the one before. Documents are kept as they were received; the files of the mirror are what link conversion makes of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = "array<struct<url:string,inline:boolean,tag:string,do_not_follow:boolean,source:string>>"
#: Tables that are written anew, a version at a time.
TABLES = {
    "info": "key string, value string",
    "cookies": "domain string, host_only boolean, path string, name string, value string, secure boolean, expires long",
}
#: Tables that grow by a part at a time. Rows with a bucket (of url) lie in folders by it, so that those of few urls are found without reading the rest.
LOGS = {
    "documents": f"url string, original_url string, filename string, mimetype string, encoding string, etag string, last_modified string, expires timestamp_ntz, links {LINKS}, received timestamp_ntz, digest string, content binary, bucket int",
    "usage": "url string, used_by string, bucket int",
    "encountered": "url string, filename string",
    "redirects": "url string, code int, target_url string",
    "deleted": "url string, filename string",
    "backups": "filename string, url string, digest string",
}
BUCKETS = 16


def bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int").alias("bucket")


def path_of(mirror: str, name: str) -> str:
    return f"{mirror.rstrip('/')}/.state/{name}"


def schema_of(name: str) -> T.StructType:
    """A log's columns, and the number of a row's part."""
    return T.StructType([*T.StructType.fromDDL(LOGS[name]), T.StructField("part", T.IntegerType())])


def is_mirror(spark: SparkSession, mirror: str) -> bool:
    return _exists(spark, f"{mirror.rstrip('/')}/.state")


def _latest(spark: SparkSession, mirror: str, name: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path_of(mirror, name))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [int(x.getPath().getName()) for x in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return f"{path_of(mirror, name)}/{max(done)}" if done else None


def read(spark: SparkSession, mirror: str, name: str) -> DataFrame:
    """The table's last complete version, or what holds now of a log (stored, url_info, redirects, documents); an empty table where there is none."""
    if name in VIEWS:
        return VIEWS[name](spark, mirror)
    found = _latest(spark, mirror, name)
    return spark.read.schema(TABLES[name]).parquet(found) if found else spark.createDataFrame([], TABLES[name])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, mirror: str, name: str, part: int) -> None:
    """Writes a part of a log."""
    columns = [f.name for f in T.StructType.fromDDL(LOGS[name])]
    df = df.select(columns)
    out = (df.repartition("bucket").write.partitionBy("bucket") if "bucket" in columns else df.write).mode("overwrite")
    out.parquet(f"{path_of(mirror, name)}/part={part}")


def log(spark: SparkSession, mirror: str, name: str) -> DataFrame:
    """All parts of a log, with the number of each row's part."""
    path = path_of(mirror, name)
    schema = schema_of(name)
    return spark.read.schema(schema).option("basePath", path).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def next_part(spark: SparkSession, mirror: str) -> int:
    """The number after those of all logs' parts."""
    return max((n for name in LOGS for n in _parts(spark, mirror, name)), default=-1) + 1


def first_part(spark: SparkSession, mirror: str) -> int:
    return min((n for name in LOGS for n in _parts(spark, mirror, name)), default=0)


def _stored(spark: SparkSession, mirror: str) -> DataFrame:
    """(url, filename): all files that a url was stored under and that weren't deleted since."""
    made = log(spark, mirror, "documents").groupBy("url", "filename").agg(F.max("part").alias("part"))
    gone = log(spark, mirror, "deleted").groupBy("url", "filename").agg(F.max("part").alias("gone"))
    return made.join(gone, ["url", "filename"], "left").filter("gone IS NULL OR gone < part").select("url", "filename")


def _url_info(spark: SparkSession, mirror: str) -> DataFrame:
    """What the last version of each stored url's document was received with."""
    names = ["original_url", "mimetype", "etag", "encoding", "last_modified", "expires", "links"]
    last = log(spark, mirror, "documents").groupBy("url").agg(F.max_by(F.struct(*names), "part").alias("d"))
    return last.join(_stored(spark, mirror).select("url").distinct(), "url", "left_semi").select("url", "d.*")


def _redirects(spark: SparkSession, mirror: str) -> DataFrame:
    return log(spark, mirror, "redirects").groupBy("url").agg(F.max_by(F.struct("code", "target_url"), "part").alias("r")).select("url", "r.*")


def _documents(spark: SparkSession, mirror: str) -> DataFrame:
    """The last version of each stored document, as it was received."""
    every = log(spark, mirror, "documents")
    last = every.groupBy("url", "filename").agg(F.max("part").alias("part"))
    return every.join(last, ["url", "filename", "part"], "left_semi").join(_stored(spark, mirror), ["url", "filename"], "left_semi").drop("part", "bucket")


def _parts(spark: SparkSession, mirror: str, name: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path_of(mirror, name))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return [int(x.partition("=")[2]) for x in found if x.startswith("part=")]


def compact(spark: SparkSession, mirror: str) -> None:
    """Between runs: makes one part of each log, of what holds now. The new part is complete before the old ones go, and until they have gone the rows that are there twice
    say the same, so a failure at any point loses nothing."""
    part = next_part(spark, mirror)
    now = {name: log(spark, mirror, name).drop("part").distinct() for name in ("usage", "backups")} | {"redirects": _redirects(spark, mirror), "documents": _documents(spark, mirror).withColumn("bucket", bucket(F.col("url")))}
    for name, rows in now.items():
        append(rows, mirror, name, part)
    for name in ("encountered", *now, "deleted"):  # what was deleted goes last: nothing of it is left in documents then
        for old in _parts(spark, mirror, name):
            if old < part:
                _remove(spark, f"{path_of(mirror, name)}/part={old}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


VIEWS = {"stored": _stored, "url_info": _url_info, "redirects": _redirects, "documents": _documents}


def write(df: DataFrame, mirror: str, name: str) -> None:
    """A new version; the old one stays until the new one is complete, so df may read it."""
    spark = df.sparkSession
    last = _latest(spark, mirror, name)
    number = int(last.rpartition("/")[2]) + 1 if last else 0
    df.write.mode("overwrite").parquet(f"{path_of(mirror, name)}/{number}")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path_of(mirror, name)}/{number - 2}")  # the one before the last is kept
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def options(spark: SparkSession, mirror: str) -> dict:
    """What an update repeats."""
    row = read(spark, mirror, "info").filter(F.col("key") == "options").first()
    return json.loads(row["value"]) if row else {}


def write_options(spark: SparkSession, mirror: str, values: dict) -> None:
    write(spark.createDataFrame([("options", json.dumps(values))], TABLES["info"]), mirror, "info")
