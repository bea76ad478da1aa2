"""Crawls of a stream of seeds: each micro-batch is crawled to its fixpoint, what is known stays known, and the mirror's files follow.

A url stays known until something asks for it again, so there is no watermark: state is a table that each batch extends. A batch that
is run again after a failure writes to the same place and leads to the same tables. Pages that came late change the files of earlier ones, which
may link to them: with a mirror, each batch converts these again, and only these; without, it names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblathe.functions import weburl as U
from weblathe.operators.crawl import Crawl, seeds
from weblathe.operators.live import LiveMirror, received
from weblathe.operators.mirror import affected
from weblathe.operators.store import kept


def crawl_stream(seed_stream: DataFrame, crawl: Callable[[], Crawl], place: str, checkpoint: str, mirror: LiveMirror | None = None, filename: Callable[[Column], Column] | None = None, now: Callable[[], str] | None = None) -> StreamingQuery:
    """seed_stream: (raw), and maybe again: whether a url is to be asked for even if it is known, as when it has expired. Writes place/known/batch=n (url, depth, order), place/log/batch=n, place/usage/batch=n (from_url, url)
    and place/changed/batch=n (url: earlier pages that link to pages of this batch). mirror: whose files are to follow. now: the time of a batch in UTC, for the mirror's documents."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "url string, depth int, `order` bigint, batch int"
        earlier = spark.read.schema(schema).option("basePath", f"{place}/known").parquet(f"{place}/known").filter(F.col("batch") < number) if number else None
        if earlier is not None and "again" in batch.columns:
            renewed = batch.filter("again").select(U.canonical(U.normalise(F.col("raw"))).alias("url")).distinct()
            earlier = kept(earlier.join(renewed, "url", "left_anti"))
        own = crawl()
        done = own.run(seeds(spark, batch.select("raw").distinct()), earlier)
        fresh = done.known if earlier is None else done.known.join(earlier.select("url"), "url", "left_anti")
        fresh.select("url", "depth", "order").write.mode("overwrite").parquet(f"{place}/known/batch={number}")
        own.expanded.select("from_url", "url").distinct().write.mode("overwrite").parquet(f"{place}/usage/batch={number}")
        if mirror is None:
            usage = spark.read.schema("from_url string, url string, batch int").option("basePath", f"{place}/usage").parquet(f"{place}/usage").filter(F.col("batch") < number)
            changed = affected(fresh, usage).join(fresh.select("url"), "url", "left_anti")
        else:
            files = received(done.saved.filter("status = 'success'"), own.responses, filename, now() if now else None)
            written = mirror.publish(number, files, done.saved.filter("status <> 'success'").select("url"), done.redirects)
            mirror.write_index()
            changed = written.join(fresh.select("url"), "url", "left_anti")
        changed.write.mode("overwrite").parquet(f"{place}/changed/batch={number}")
        done.log.write.mode("overwrite").parquet(f"{place}/log/batch={number}")

    return seed_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
