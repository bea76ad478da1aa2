"""The urls that a crawl won't process again, as a table that its waves append to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.operators.store import keep

SCHEMA = "url string, own boolean, depth int, `order` bigint"


class Known:
    """(url, own, depth, order) by wave; own: whether the url itself was saved, or a redirect from it.

    before: what is known from the start (url, depth, order). With buckets the table is dealt by url once, when it is written, so that waves meet it without shuffling it again: only
    the wave's own links move, to as many tasks as there are buckets. Each wave adds a file a bucket, which is too many where waves are small and few; without buckets, waves meet the
    table by whatever join its size suggests.
    """

    def __init__(self, spark: SparkSession, place: str, before: DataFrame, buckets: int | None = None):
        self.spark, self.place, self.before, self.buckets = spark, f"{place}/known", before, buckets
        self.name = f"known_{uuid.uuid4().hex}"
        if buckets:
            self._append(before.withColumn("own", F.lit(False)), -1)

    def _append(self, rows: DataFrame, wave: int) -> None:
        rows = rows.select("url", "own", F.col("depth").cast("int"), F.col("order").cast("long"), F.lit(wave).alias("wave"))
        # dealt to one task a bucket, so that each writes one file
        rows.repartition(self.buckets, "url").write.format("parquet").bucketBy(self.buckets, "url").option("path", self.place).mode("append").saveAsTable(self.name)

    def add(self, rows: DataFrame, wave: int) -> DataFrame:
        """Writes a wave's rows, and returns them with wave."""
        if self.buckets:
            self._append(rows, wave)
            return self.spark.table(self.name).filter(F.col("wave") == wave)
        path = f"{self.place}/wave={wave}"
        keep(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path).withColumn("wave", F.lit(wave))

    def waves(self) -> DataFrame:
        """All waves' rows, with wave."""
        if self.buckets:
            return self.spark.table(self.name).filter("wave >= 0")
        return self.spark.read.schema(f"{SCHEMA}, wave int").parquet(self.place)

    def rows(self) -> DataFrame:
        """(url, depth, order) of all that is known."""
        if self.buckets:
            return self.spark.table(self.name).select("url", "depth", "order")
        return self.before.unionByName(self.waves().select("url", "depth", "order"))
