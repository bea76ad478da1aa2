"""The tables of a local mirror: names, stored files, reverse index, link targets, pruning, index page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.functions import weburl as U
from weblathe.operators.store import kept
from weblathe.plans.rules import TESTS, RuleError


def default_filename(netloc: Column, path: Column, query: Column, mime: Column) -> Column:
    """netloc/path; `index` for folders; the ending of the content type in place of a foreign or missing one; a digest of the query."""
    base = F.concat(netloc, F.lit("/"), F.regexp_replace(path, r"\A/+", ""))
    base = F.when(base.endswith("/"), F.concat(base, F.lit("index"))).otherwise(base)
    name = U.filename(base)
    own = F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)

    def of(exts: Column) -> Column:
        stem = F.substring(base, F.lit(1), F.char_length(base) - F.char_length(own))
        foreign = (F.size(exts) > 0) & ~F.array_contains(exts, own)
        ending = F.when(foreign, F.get(exts, F.lit(0))).otherwise(own)
        return F.concat(stem, F.when(query != "", F.concat(F.lit("_"), F.substring(F.md5(query), 1, 10))).otherwise(""), ending)

    return safe_path(U.let(T.extensions(mime), of))


def safe_path(file: Column) -> Column:
    """Segments of at most 255 characters, none of which is `..`."""
    return F.array_join(F.transform(F.split(file, "/"), lambda s: F.substring(F.when(s == "..", "__").otherwise(s), 1, 255)), "/")


def layout(template: str) -> Column:
    """A file name from a template: {test} or {test,filter,...}; filters are md5 and a number of characters; | separates too."""
    out = []
    for text, inside in re.findall(r"([^{]*)(?:\{([^}]*)\})?", template):
        if text:
            out.append(F.lit(text))
        if not inside:
            continue
        name, *filters = re.split(r"[,|]", inside)
        if name not in TESTS or TESTS[name].kind != "S":
            raise RuleError(f"{name!r} can't be used in a layout")
        t = TESTS[name]
        v = T.yes_no(t.column()) if t.type == "bool" else F.coalesce(t.column().cast("string"), F.lit(""))
        for f in filters:
            if f == "md5":
                v = F.md5(v)
            elif f.isdigit():
                v = F.substring(v, 1, int(f))
            elif f:
                raise RuleError(f"there is no filter {f!r}")
        out.append(v)
    return safe_path(F.concat(*out, F.lit("")))


def url_usage(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(url, used_by): which pages hold a link to a url; of `pages` only if given."""
    rows = links if pages is None else links.join(pages.select(F.col("url").alias("from_url")), "from_url", "left_semi")
    return rows.select(F.col("target").alias("url"), F.col("from_url").alias("used_by")).filter("url IS NOT NULL").distinct()


def usage_pages(usage: DataFrame, rows: int = 10_000) -> DataFrame:
    """(url, page, used_by, next): each url's users in order, as posting lists of at most so many, and the number of the list that goes on, if any.

    Users are put in order by ranges of (url, user), so that those of a url that every page links to lie in many tasks; a url's places go on from range to range.
    """
    parts = usage.select("url", "used_by").distinct().repartitionByRange("url", "used_by").sortWithinPartitions("url", "used_by")
    parts = kept(parts.select("url", "used_by", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn")))
    runs = parts.groupBy("url", "part").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("url", "part", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("url")).alias("all"))
    placed = parts.join(runs, ["url", "part"]).withColumn("page", F.floor((F.col("turn") - F.col("first") + F.col("before")) / rows).cast("long"))
    lists = placed.groupBy("url", "page", "all").agg(F.sort_array(F.collect_list("used_by")).alias("used_by"))
    return lists.select("url", "page", "used_by", F.when((F.col("page") + 1) * rows < F.col("all"), F.col("page") + 1).alias("next"))


def usage_sets(usage: DataFrame) -> DataFrame:
    return usage.groupBy("url").agg(F.sort_array(F.collect_set("used_by")).alias("used_by"))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(url, filename): all files that a url was ever stored under."""
    return stored.select("url", "filename").unionByName(new.select("url", "filename")).distinct()


def upsert_info(info: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by url; new ones win."""
    return info.join(new.select("url"), "url", "left_anti").unionByName(new, allowMissingColumns=True)


def encounter(urls: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, filename) of urls that were met without being saved; a url without a file is an error."""
    found = urls.select("url").distinct().join(stored.groupBy("url").agg(F.min("filename").alias("filename")), "url", "left")
    return found.withColumn("filename", F.coalesce("filename", F.raise_error(F.concat(F.lit("not stored: "), F.col("url")))))


def last_redirects(redirects: DataFrame) -> DataFrame:
    """(url, code, target_url): of several redirects of a url the last by order."""
    return redirects.groupBy("url").agg(F.max_by(F.struct("code", "target_url"), "order").alias("r")).select("url", "r.code", "r.target_url")


def link_targets(links: DataFrame, encountered: DataFrame, redirects: DataFrame, usage: DataFrame | None) -> DataFrame:
    """links(from_url, from_file, n, absolute, original, target, fragment) with new: what the link becomes, null if it stays.

    A local file, directly or through a redirect, by its relative path and fragment; the target of a permanent
    redirect; an absolute url, if any page's known links have it (usage; without it, all do); else nothing.
    """
    direct = encountered.select(F.col("url").alias("d_url"), F.col("filename").alias("d_file"))
    red = redirects.select(F.col("url").alias("r_url"), "code", "target_url")
    via = encountered.select(F.col("url").alias("v_url"), F.col("filename").alias("v_file"))
    rows = (
        links.join(direct, F.col("target") == F.col("d_url"), "left").join(red, F.col("target") == F.col("r_url"), "left")
        .join(via, F.col("target_url") == F.col("v_url"), "left")
    )
    if usage is None:
        rows = rows.withColumn("u_url", F.col("target"))
    else:
        rows = rows.join(usage.select(F.col("url").alias("u_url")).distinct(), F.col("target") == F.col("u_url"), "left")
    file = F.coalesce("d_file", "v_file")
    tail = F.when(F.col("fragment") != "", F.concat(F.lit("#"), F.col("fragment"))).otherwise("")
    new = (
        F.when(file.isNotNull(), F.concat(U.relative(file, F.col("from_file")), tail))
        .when(F.col("code") == 301, F.col("target_url"))
        .when(F.col("u_url").isNotNull(), F.col("absolute"))
    )
    return rows.select(*links.columns, new.alias("new"))


def affected(new: DataFrame, links: DataFrame) -> DataFrame:
    """(url) of the pages to convert when urls become new: these, and all pages with links(from_url, url) to one of them."""
    return new.select("url").unionByName(links.join(new.select("url"), "url", "left_semi").select(F.col("from_url").alias("url"))).distinct()


def prune(stored: DataFrame, encountered: DataFrame) -> DataFrame:
    """(url, filename, gone) of files to delete: of urls that this run didn't meet (gone), and old names of others."""
    met = encountered.groupBy("url").agg(F.min("filename").alias("current"))
    rows = stored.join(met, "url", "left")
    return rows.filter("current IS NULL OR filename <> current").select("url", "filename", F.col("current").isNull().alias("gone"))


def index_page(stored: DataFrame, buckets: int = 16) -> DataFrame:
    """One row: an anchor per stored url, by file name. Anchors are joined in ranges of names first."""
    names = stored.groupBy("url").agg(F.min("filename").alias("f"))
    a = F.concat(F.lit('<a href="'), F.col("f"), F.lit('">'), F.col("f"), F.lit("</a><br>"))
    parts = kept(names.repartitionByRange(buckets, "f").sortWithinPartitions("f").select(F.spark_partition_id().alias("p"), "f", a.alias("a")))
    joined = parts.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "a"))), lambda x: x["a"]), "").alias("html"))
    return joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "html"))), lambda x: x["html"]), "").alias("html"))


def unchanged(info: DataFrame, responses: DataFrame, key: str = "url") -> DataFrame:
    """responses with what a conditional request gets: 304 if the etag or date that info (a row per key) has stored is still the response's."""
    old = info.select(key, F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_date"))
    same = (F.col("old_etag") == F.try_element_at("headers", F.lit("etag"))) | (F.col("old_date") == F.try_element_at("headers", F.lit("last-modified")))
    return responses.join(old, key, "left").withColumn("status", F.when(F.coalesce(same, F.lit(False)), 304).otherwise(F.col("status"))).drop("old_etag", "old_date")


def skipped(no_check: bool, trust_expires: bool, run_ts: str, expires: Column) -> Column:
    """Whether a url of an earlier run isn't requested at all: never, always, or until it expires."""
    return F.lit(no_check) | (F.lit(trust_expires) & F.coalesce(expires > F.lit(run_ts).cast("timestamp_ntz"), F.lit(False)))
