"""Link extraction and rewriting as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions import charsets, scanners
from weblathe.functions import text as T
from weblathe.functions import weburl as U
from weblathe.sources.seeds import encoding

MENTION = "struct<pos:int,len:int,raw:string,inline:boolean,tag:string,do_not_follow:boolean,base:string,quote:string>"
_EXTRACTORS: dict[str, Callable[[str], list]] = {"text/html": scanners.html_mentions, "text/css": scanners.css_mentions}


def register_extractor(mime: str, extractor: Callable[[str], list]) -> None:
    """extractor: text -> list of scanners.Mention. Has to be importable where the executors run."""
    _EXTRACTORS[mime] = extractor


_FIELDS = [("pos", pa.int32()), ("len", pa.int32()), ("raw", pa.string()), ("inline", pa.bool_()), ("tag", pa.string()), ("do_not_follow", pa.bool_()), ("base", pa.string()), ("quote", pa.string())]


#: Bytes of documents that go to a Python worker at a time, where nobody has said how many.
BATCH = 4 << 20


def small_batches() -> None:
    """A worker holds a few copies of a batch, which by Spark's own limit has 64 MB."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", SparkSession.active()
    if spark.conf.get(name).removesuffix("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH))


def mentions(content: Column, mime: Column, charset: Column | None = None) -> Column:
    """array of mentions of a text, by its exact content type; empty for other types. With a charset (a label), content is bytes."""
    small_batches()
    known = dict(_EXTRACTORS)

    @F.arrow_udf(f"array<{MENTION}>")
    def scan(texts: pa.Array, mimes: pa.Array, labels: pa.Array) -> pa.Array:
        columns, ends = [[] for _ in _FIELDS], [0]
        for t, m, label in zip(texts, mimes.to_pylist(), labels.to_pylist()):
            if m in known:
                t = t.as_py()
                for x in known[m](charsets.text_of(t, label) if isinstance(t, bytes) else t or ""):
                    for column, value in zip(columns, x):
                        column.append(value)
            ends.append(len(columns[0]))
        found = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return scan(content, mime, F.lit(None).cast("string") if charset is None else charset)


def header_links(header: Column) -> Column:
    """array of mentions of an HTTP Link header: <url>; rel=..., one of each rel."""
    parts = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"(<[^>]*>[^<]*)"), F.lit(1))

    def one(x: Column) -> Column:
        url = F.trim(F.regexp_extract(x, r"<([^>]*)>", 1))
        rel = F.regexp_extract(x, r"(?i);\s*rel\s*=\s*\"?([^\";,]*)", 1)
        needed = F.arrays_overlap(F.split(rel, " "), F.array(*map(F.lit, sorted(scanners.REQUISITE_RELS))))
        return F.struct(url.alias("raw"), needed.alias("inline"), F.when(rel == "", url).otherwise(rel).alias("rel"))

    found = F.transform(parts, one)
    first = F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: y["rel"] == x["rel"]))
    return F.transform(first, lambda x: F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), x["raw"].alias("raw"), x["inline"].alias("inline"), F.lit(None).cast("string").alias("tag"), F.lit(False).alias("do_not_follow"), F.lit(None).cast("string").alias("base"), F.lit("keep").alias("quote")))


def extract_links(documents: DataFrame, url: str = "url", content: str = "content", mime: str = "mime", link_header: str | None = None, charset: str | None = None) -> DataFrame:
    """A row per link: documents' other columns, n (its place), raw, absolute, inline, tag, do_not_follow, source.

    Header links come before the document's. With a charset (the column of labels), content is bytes.
    """
    keep = [c for c in documents.columns if c not in (content, link_header, charset)]
    found = documents.withColumn("found", mentions(F.col(content), F.col(mime), F.col(charset) if charset else None))
    every = F.col("found") if link_header is None else F.concat(header_links(F.col(link_header)), F.col("found"))
    rows = found.select(*keep, F.posexplode(every).alias("n", "m"))
    here = F.when(F.col("m.base").isNotNull(), U.join(F.col(url), F.col("m.base"))).otherwise(F.col(url))
    return rows.select(
        *keep, "n", F.col("m.raw").alias("raw"), U.join(here, F.col("m.raw")).alias("absolute"), "m.inline", "m.tag", "m.do_not_follow",
        F.when(F.col("m.pos") < 0, "http-header").alias("source"),
    )


def charset_of(content: Column, headers: Column) -> Column:
    """The label of a response's charset: stated by its header, or found in its bytes."""
    stated = F.regexp_extract(F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w:.-]+)", 1)
    return F.lower(encoding(content, F.lower(stated)))


def links_of(responses: DataFrame) -> DataFrame:
    """from_url, n, absolute, inline, tag, do_not_follow, source of the links of responses, in any charset; header links first."""
    at = F.coalesce("final_url", "url") if "final_url" in responses.columns else F.col("url")
    header = lambda k: F.try_element_at("headers", F.lit(k))
    pages = responses.select("url", at.alias("at"), "content", charset_of(F.col("content"), F.col("headers")).alias("charset"), T.mime(header("content-type")).alias("mime"), header("link").alias("link"))
    found = extract_links(pages, url="at", link_header="link", charset="charset")
    return found.select(F.col("url").alias("from_url"), "n", "absolute", "inline", "tag", "do_not_follow", "source")


def rewrite_links(content: Column, mime: Column, new: Column) -> Column:
    """content with the raw urls that are keys of the map new replaced by its values."""

    small_batches()
    known = dict(_EXTRACTORS)

    @F.pandas_udf("string")
    def run(texts: pd.Series, mimes: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([t if m not in known or not d else scanners.rewritten(t, m == "text/css", dict(d), known[m]) for t, m, d in zip(texts, mimes, maps)])

    return run(content, mime, new)


def rewrite_documents(content: Column, mime: Column, charset: Column, new: Column) -> Column:
    """Documents' bytes with the raw urls that are keys of the map new replaced by its values; every other byte stays as it was received."""
    small_batches()
    known = dict(_EXTRACTORS)

    @F.arrow_udf("binary")
    def run(contents: pa.Array, mimes: pa.Array, labels: pa.Array, maps: pa.Array) -> pa.Array:
        out = []
        for c, m, label, d in zip(contents, mimes.to_pylist(), labels.to_pylist(), maps.to_pylist()):
            c = c.as_py()
            if c and d and m in known:
                c = charsets.spliced(c, label, scanners.changes(charsets.text_of(c, label), m == "text/css", dict(d), known[m]))
            out.append(c)
        return pa.array(out, pa.binary())

    return run(content, mime, charset, new)
