"""The crawl log: a line per link, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.functions.text import shorten

#: Reasons of the usual HTTP errors.
REASONS = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable"}


def mark(status: Column, saved: Column, code: Column) -> Column:
    """The sign in front of a line; null for links that have none."""
    return (
        F.when(status == "duplicate", F.lit(None).cast("string"))
        .when((status == "success") & saved, "⚑").when(status == "success", "+").when(status == "not-modified", "304")
        .when(status == "rule-deny", "-").when(status == "redirect", "→").when(status == "http-error", code.cast("string")).when(status == "connect-error", "err")
        .otherwise("")
    )


def reason(status: Column, code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.when(status == "connect-error", "connection refused").when(status == "http-error", F.try_element_at(known, code))


def lines(log: DataFrame, width: int = 70, follow_rule: Column | None = None, save_rule: Column | None = None) -> DataFrame:
    """log with mark and line; links without a mark have no line."""
    m = mark(F.col("status"), F.col("saved"), F.col("code"))
    counts = F.when(F.col("links_total") > 0, F.concat(F.lit("+"), F.col("links_followed").cast("string"), F.lit("/"), F.col("links_total").cast("string")))
    rules = [F.when(r.isNotNull(), F.concat(F.lit("@"), r)) for r in (follow_rule, save_rule) if r is not None]
    line = F.concat_ws(" ", m, reason(F.col("status"), F.col("code")), shorten(F.col("original_url"), width), counts, *rules)
    return log.withColumn("mark", m).withColumn("line", F.when(m.isNotNull(), line))


def counters(log: DataFrame) -> DataFrame:
    """One row: links processed, saved, queued, and errors."""
    return log.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("saved").alias("saved"), F.sum("links_followed").cast("long").alias("queued"),
        F.count_if(F.col("status").endswith("error")).alias("errors"),
    )
