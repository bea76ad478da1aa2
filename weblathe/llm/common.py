"""What the operators of this subpackage share: reading tables, keeping intermediate results, and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.operators.store import kept

__all__ = ["SPACE", "SPACES", "WORD", "kept", "let", "small_batches", "table", "without", "words"]

#: ASCII white space, as the contracts of the queries have it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows a batch between the JVM and Python workers where nobody has said how many: 10,000 texts are too many to hold in both."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: list[str]) -> Column:
    """text without any of chars; a few byte searches are faster than one regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The runs of other than ASCII white space, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
