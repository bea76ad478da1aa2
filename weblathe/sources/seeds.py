"""Where crawls start: urls, files of urls, local files, POST data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions.text import EXTENSIONS
from weblathe.functions.weburl import let


def user_url(text: Column) -> Column:
    """struct<target, data, post>: `target{data}`; data is k=v,k=v to send, or the base url of a local file."""
    m = r"(?s)\A(.*?)(?:\{([^}]*)\})?\z"
    target, data = F.regexp_extract(text, m, 1), F.regexp_extract(text, m, 2)
    return F.struct(target.alias("target"), F.nullif(data, F.lit("")).alias("data"), F.when(data.contains("="), F.str_to_map(data, F.lit(","), F.lit("="))).alias("post"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(raw): a url a line; blank lines are left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("raw")).filter("raw <> ''")


def mime_of(name: Column) -> Column:
    """text/html or text/css by the name's ending; null for others."""
    pairs = [F.lit(x) for mime in ("text/html", "text/css") for e in EXTENSIONS[mime] for x in (e, mime)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(name, r"(\.[^./]*)\z", 1)))


def local_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Responses of files, with status 200; their links are relative to base_url and they are never mirrored."""
    if not base_url:
        raise ValueError("a local file needs a base url: path{url}")
    files = spark.read.format("binaryFile").load(path)
    mime = F.coalesce(mime_of(F.lit(base_url)), mime_of(F.col("path")), F.lit("text/html"))
    return files.select(
        F.lit(base_url).alias("url"), F.col("path").alias("file"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), mime).alias("headers"),
        "content", F.array().cast("array<string>").alias("redirects"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("is_local"),
    )


def encoding(content: Column, stated: Column) -> Column:
    """The stated charset, else a byte order mark, else <meta charset> in the first 1024 bytes or the @charset that a style sheet begins with, else utf-8."""
    start = F.substring(content, 1, 3)
    meta = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"(?i)<meta[^>]*charset\s*=\s*[\"']?([\w:.-]+)", 1))
    bom = F.when(F.hex(start) == "EFBBBF", "utf-8").when(F.hex(F.substring(content, 1, 2)) == "FFFE", "utf-16le").when(F.hex(F.substring(content, 1, 2)) == "FEFF", "utf-16be")
    sheet = F.regexp_extract(F.decode(F.substring(content, 1, 100), "ISO-8859-1"), r'\A@charset "([\w:.-]+)";', 1)
    return let(meta, lambda m: F.coalesce(F.nullif(stated, F.lit("")), bom, F.nullif(m, F.lit("")), F.nullif(sheet, F.lit("")), F.lit("utf-8")))
