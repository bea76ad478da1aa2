"""Documents that expire are asked for again: a timer on the state of each url.

The clock is the stream's own event time, so a run over old events gives what a live one gave: a url is due once the watermark has passed the expiry that it was last received
with. Receiving it again in time moves its timer; receiving it without an expiry stops it. State is one number a url with a timer, and goes when the timer has run out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weblathe.sources import state


def documents_stream(spark: SparkSession, mirror: str) -> DataFrame:
    """(url, expires, at) of the documents of a mirror, as they come."""
    schema = state.schema_of("documents")
    rows = spark.readStream.schema(schema).option("basePath", state.path_of(mirror, "documents")).parquet(state.path_of(mirror, "documents"))
    return rows.select("url", F.col("expires").cast("timestamp").alias("expires"), F.col("received").cast("timestamp").alias("at"))


def expired(received: DataFrame, ticks: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """(raw, again) of urls whose expiry has passed, once for each time that they were received; as seeds for crawl_stream.

    received: a stream of (url, expires, at); rows without a url only move the clock. ticks: another stream (at) that moves it. delay: how late rows may come.
    """
    rows = received.select("url", "expires", "at")
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("expires"), "at"))

    def timer(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        due = False
        if held.hasTimedOut:
            held.remove()
            due = True
        elif key[0] is not None:
            last = pd.concat(list(batches)).sort_values("at", kind="stable").iloc[-1]
            expires = None if pd.isna(last["expires"]) else int(last["expires"].timestamp() * 1000)
            if held.exists:
                held.remove()
            if expires is not None:
                due = expires <= held.getCurrentWatermarkMs()
                if not due:
                    held.update((expires,))
                    held.setTimeoutTimestamp(expires)
        yield pd.DataFrame({"raw": [key[0]], "again": [True]} if due else {"raw": pd.Series([], dtype=str), "again": pd.Series([], dtype=bool)})

    timed = rows.withWatermark("at", delay).groupBy("url")
    return timed.applyInPandasWithState(timer, "raw string, again boolean", "expires long", "append", GroupStateTimeout.EventTimeTimeout)
