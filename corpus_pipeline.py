"""A corpus pipeline: quality rules, exact dedup, near-duplicate removal, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All stages but the last return the columns of
documents. Columns that documents may have besides these are dropped. ORACLE_SQL is None, as SQL can't express the mixing and the encoding; tests
compare the rules, the exact and near duplicates and the encoding with plain versions, and the mixing in its operator's own test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.llm import exact_dedup, jaccard_join, mixing, pieces, quality_rules
from weblathe.llm.common import kept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all thresholds. Null and empty texts fail; each row is judged alone, so null ids and repeated rows are no
    matter, and an empty table stays empty."""
    return quality_rules.judge(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, null last. Null counts as empty; of rows that are equal in id and
    length too any one stays."""
    return exact_dedup.dedup(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies; null ids come last, and of these the first text by digest stays.

    Documents are told apart by their texts, of which the stage before has left one each, and not by their ids.
    """
    return jaccard_join.representatives(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix takes it. Null sources are one source; texts without words aren't taken; null ids are no matter."""
    mixed = mixing.mix(docs.select(COLUMNS)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and its text as decoded from them. Null and empty texts have no ids; each row is encoded alone."""
    import public_tokenizers

    coded = pieces.encode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "ids", "n_ids", F.col("decoded").alias("text"), "round_trip")


STAGES = [("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("SentencePiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
