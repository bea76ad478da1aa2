"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after deleting ASCII white space. Candidates (digest and whole normalised
text) are combined in three stages, each of which groups by the full content and not by the digest alone: within a
task, within a salt of the digest, and over the salts. The winner of a group is the row with the most code points,
then the smallest doc_id, packed into one decimal so that all stages are hash aggregations with a fixed-size buffer.

Null is an empty text; empty texts are equal to each other. A null doc_id comes last among ties; where
it wins by length, keep_id is null. Of rows that repeat with the same doc_id and length one is kept. An empty table
gives no rows. Other columns pass through `dedup` unless their names are those of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.llm.common import SPACES, kept, table, without

SALTS = 32
#: Groups of more than one row whose winners (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST = 200_000
#: Room for an id below a length: ids are flipped so that the smallest is the largest, and null is 0.
_ROOM = 2**65
_TOP = 2**63


def normalised(text: Column) -> Column:
    return without(F.coalesce(text, F.lit("")), SPACES)


def _big(x) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(38,0)")


def _rank(text: Column, doc_id: Column) -> Column:
    """Largest for the row that stays: code points first, then the smaller doc_id."""
    length = F.char_length(F.coalesce(text, F.lit("")))
    return (_big(length) * _big(_ROOM) + F.coalesce(_big(_TOP) - _big(doc_id), _big(0))).cast("decimal(38,0)")


def _doc_id(rank: Column) -> Column:
    low = (rank % _big(_ROOM)).cast("decimal(38,0)")
    return F.when(low != 0, (_big(_TOP) - low).cast("long"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """A row per distinct content: digest, content, rank of the row that stays, and n, how many rows have it."""
    rows = docs.select(
        normalised(F.col(text)).alias("content"), _rank(F.col(text), F.col(doc_id)).alias("rank"), F.lit(1).cast("long").alias("n"),
        F.pmod(F.xxhash64(F.lit(7), F.spark_partition_id()), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    best = [F.max("rank").alias("rank"), F.sum("n").alias("n")]
    # The salt is the task's: equal contents of a task become one row before the shuffle, and a hot group is one row a task, over all salts.
    salted = rows.groupBy("digest", "content", "salt").agg(*best)
    return salted.groupBy("digest", "content").agg(*best)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Rows learn their group's winner by digest; a digest that turned out to stand for several contents (never seen for
    SHA-256) would make the query fail rather than merge them.
    """
    winners = (
        groups(docs, doc_id, text, salts)
        .groupBy("digest")
        .agg(F.max("rank").alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("contents"))
    )
    winners = kept(winners.filter(F.assert_true(F.col("contents") == 1, "one digest of two different texts").isNull()).filter("size > 1").select("digest", "best", "size"))
    names = [c for c in docs.columns if c.lower() not in RESULTS or c.lower() in (doc_id.lower(), text.lower())]
    rows = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("given"), F.col(doc_id).alias("id"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), _rank(F.col(text), F.col(doc_id)).alias("rank"),
    )
    rows = rows.join(F.broadcast(winners) if winners.count() <= BROADCAST else winners, "digest", "left")
    single = F.col("size").isNull()
    tied = F.coalesce(F.col("rank") == F.col("best"), F.lit(False))
    if docs.groupBy(F.col(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        out = rows.withColumn("stays", single | tied)
    else:  # rows that repeat an id and a length share a rank: one of each task is taken first, then one of these
        lost = rows.filter(~tied).withColumn("stays", single)
        own = rows.filter(tied).withColumn("task", F.spark_partition_id())
        # Which row has which turn isn't fixed, so it is written before both branches read it.
        own = kept(own.withColumn("turn", F.row_number().over(Window.partitionBy("digest", "task").orderBy(F.lit(1)))))
        of_tasks = own.filter("turn = 1").withColumn("stays", F.row_number().over(Window.partitionBy("digest").orderBy("task")) == 1)
        out = lost.unionByName(of_tasks.unionByName(own.filter("turn > 1").withColumn("stays", F.lit(False))).drop("task", "turn"))
    results = {
        "keep_id": F.when(single, F.col("id")).otherwise(_doc_id(F.col("best"))), "group_size": F.coalesce("size", F.lit(1).cast("long")),
        "kept": F.col("stays"), "text_sha256": F.lower(F.hex("digest")),
    }
    return out.select(*[F.col("given")[c].alias(c) for c in names if c.lower() not in RESULTS], *[c.alias(k) for k, c in results.items()])


RESULTS = {"keep_id", "group_size", "kept", "text_sha256"}


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s)::BIGINT AS group_size,
  row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)
"""
