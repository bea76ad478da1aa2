"""Mixing sources to target weights by entropy balancing.

A source's target is its share, by weight, of budget times all words; it stops at `most` times the source's own words,
and the excess is shared again by weight. Rates of documents stay as near to one as the targets allow: among all rates
r with sum(r * size) = target in each source, those of least relative entropy sum(r log r - r) are exponential in the
size, r = min(most, exp(l * size / scale)), and l is the dual variable of the source's constraint. The dual is
convex; Newton steps, kept within a bracket, solve it. Each step is one aggregation over the histogram of (source,
size), which is all that the dual depends on; the driver holds one row a source.

Rates depend on a document's source and size only, so copies are decided for classes: all documents of a source and a size, cut by a
hash of the document where they are more than `bucket`. Going through classes from the largest size to the smallest, each takes the whole number of
copies that brings the words taken so far nearest to the words due so far, so that a run of classes ends within about half of its
smallest document of its target; a source's classes are dealt into runs of about `run` classes. Within a class, copies
go to all documents alike, and what is left over goes to those whose hashes come first. So texts never leave the JVM, no source's
rows meet in one task, and sums are decimals, equal in every run and order of tasks.

The driver holds one row of totals at a time. Sources are a table: their targets come from rounds of one aggregation each, and their duals from
Newton steps that join the table to the histogram.

Null and empty texts have size 0 and take nothing; rows with a null source form one source, which comes last; a null or
repeated doc_id is fine, as rows are never joined by it: of rows that are equal in id and text any may take the copy. Sources without words have
target 0. An empty table gives no rows. Other columns pass through unless their names are those of the results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.llm.common import WORD, kept, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
#: Documents of a class, about, and classes of a run.
BUCKET, RUN = 2000, 50_000
STEPS = 60
#: Rows of a table of large classes that is broadcast; a longer one is shuffled.
BROADCAST = 50_000
#: Sums of doubles are made of decimals, which don't depend on the order.
_EXACT = "decimal(38,6)"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with no: their place by code point from 0, null last. The driver sees one number a partition."""
    parts = kept(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    first = parts.groupBy("part").agg(F.min("at").alias("at"), F.min("source").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    ends, shifts = 0, []
    for r in sorted(first, key=lambda r: (r["s"] is None, (r["s"] or "").encode())):
        shifts.append((r["part"], ends - r["at"]))
        ends += r["n"]
    by_part = sources.sparkSession.createDataFrame(shifts, "part int, shift long")
    return parts.join(by_part, "part").withColumn("no", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def unit(sources: DataFrame, budget: float, most: float) -> float:
    """The words that a weight of one gets: shares of budget * words by weight; a share above most times its source's words stops
    there and the rest goes to the others. Sources that stop are those with weight * unit >= most * words."""
    total = sources.agg(F.sum("words")).first()[0] or 0
    now = 0.0
    while True:
        full = F.col("weight") * F.lit(now) >= F.lit(float(most)) * F.col("words")
        r = sources.agg(F.sum(F.when(full, F.col("words"))).alias("stopped"), F.sum(F.when(~full, F.col("weight").cast(_EXACT))).alias("weight")).first()
        if not r["weight"]:
            return math.inf
        new = (budget * total - most * (r["stopped"] or 0)) / float(r["weight"])
        if new <= now:
            return now
        now = new


def solved(histogram: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """sources with dual, the dual variable of each; infinite where every document is taken most times.

    histogram: no, size, n. A step joins it to the sources that aren't done, which is a short table or a shuffle of both.
    """
    words, target = F.col("words").cast("double"), F.col("target")
    every, none = target >= most * words * (1 - 1e-12), target <= 0
    first = F.when(none, math.log(1e-12)).when(every, math.inf).otherwise(F.log(F.greatest(target, F.lit(1e-12)) / F.greatest(words, F.lit(1.0))))
    now = sources.withColumns({
        "scale": F.greatest(F.lit(1.0), F.col("squares").cast("double") / F.greatest(words, F.lit(1.0))), "dual": first,
        "low": F.lit(-math.inf), "high": F.lit(math.inf), "done": every | none,
    })
    now = kept(now)
    for _ in range(STEPS):
        if now.filter("NOT done").isEmpty():
            break
        step = F.col("dual") * F.col("size") / F.col("scale")
        rate = F.when(step >= math.log(most), F.lit(float(most))).otherwise(F.exp(step))
        rows = histogram.join(now.filter("NOT done").select("no", "dual", "scale"), "no").withColumn("w", F.col("n") * F.col("size"))
        slope = F.when(step < math.log(most), F.exp(step) * F.col("w") * F.col("size") / F.col("scale"))
        sums = rows.groupBy("no").agg(F.sum((rate * F.col("w")).cast(_EXACT)).cast("double").alias("got"), F.coalesce(F.sum(slope.cast(_EXACT)).cast("double"), F.lit(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        both = now.join(sums, "no", "left").withColumn("open", ~F.col("done")).withColumns({
            "done": F.col("done") | (F.abs(gap) <= 1e-9 * F.col("target")),
            "low": F.when(F.col("open") & (gap <= 0), F.col("dual")).otherwise(F.col("low")), "high": F.when(F.col("open") & (gap > 0), F.col("dual")).otherwise(F.col("high")),
        })
        newton = F.when(F.col("slope") > 0, F.col("dual") - gap / F.col("slope"))
        lower = F.col("high") - 2 * F.greatest(F.lit(1.0), F.abs("high"))
        upper = F.col("low") + 2 * F.greatest(F.lit(1.0), F.abs("low"))
        bracket = F.when(F.col("low") == -math.inf, lower).when(F.col("high") == math.inf, upper).otherwise((F.col("low") + F.col("high")) / 2)
        new = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(bracket)
        now = kept(both.withColumn("dual", F.when(F.col("done"), F.col("dual")).otherwise(new)).drop("got", "slope", "open"))
    return now


def rounded(sizes: np.ndarray, rates: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Copies that each class of counts documents takes together, in the order given, so that words taken follow words due."""
    out, behind = np.zeros(len(sizes), np.int64), 0.0
    for i, (s, r, n) in enumerate(zip(sizes.tolist(), rates.tolist(), counts.tolist())):
        if s:
            behind += r * s * n
            c = min(most * n, max(0, math.floor(behind / s + 0.5)))
            behind -= c * s
            out[i] = c
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, bucket: int = BUCKET, run: int = RUN, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken = copies * size."""
    names = [c for c in docs.columns if c.lower() not in RESULTS or c.lower() in (text.lower(), source.lower(), doc_id.lower())]
    given = F.struct(*[F.col(c) for c in names]).alias("given")
    hashed = F.xxhash64(F.lit(11), F.col(doc_id), F.col(text)) if text in docs.columns else F.xxhash64(F.lit(11), F.col(doc_id))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = docs.select(given, (size_of(F.col(text)) if size is None else size).alias("size"), key.alias("key"), F.col(source).cast("string").alias("source"), hashed.alias("hash"))
    counted = kept(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    square = F.col("n").cast("decimal(18,0)") * (F.col("size") * F.col("size")).cast("decimal(20,0)")
    sources = counted.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(square).alias("squares"), F.count(F.lit(1)).alias("classes"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    sources = kept(numbered(sources).withColumn("weight", weight))
    per_weight, most_words = unit(sources, budget, most), F.lit(float(most)) * F.col("words")
    share = F.least(most_words, F.col("weight") * F.lit(per_weight)) if math.isfinite(per_weight) else most_words
    sources = sources.withColumn("target", F.when(F.col("words") > 0, share).otherwise(0.0))
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("int").alias("cuts")
    histogram = kept(counted.join(sources.select("key", "no"), "key").select("key", "no", "size", "n", cuts))
    sources = solved(histogram, sources, most)
    # classes of at most about bucket documents, each with the copies that it takes
    large = kept(histogram.filter("cuts > 1").select("key", "size", "cuts"))
    if large.count() <= BROADCAST:
        large = F.broadcast(large)
    rows = rows.drop("source").join(large, ["key", "size"], "left")
    rows = rows.withColumn("cut", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64(F.lit(5), "hash"), F.col("cuts"))).otherwise(0).cast("int"))
    parts = rows.filter("cuts IS NOT NULL").groupBy("key", "size", "cut").agg(F.count(F.lit(1)).alias("n"))
    classes = histogram.filter("cuts = 1").select("key", "size", F.lit(0).alias("cut"), "n").unionByName(parts)
    classes = classes.join(sources.select("key", F.col("words").alias("source_size"), "target", "dual", "scale", "classes"), "key")
    step = F.col("dual") * F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, 0.0).when(step >= math.log(most), float(most)).otherwise(F.exp(step))
    part = F.pmod(F.xxhash64(F.lit(3), "size", "cut"), F.greatest(F.lit(1), F.ceil(F.col("classes") / run)).cast("long"))
    classes = classes.select("key", "size", "cut", "n", "source_size", "target", rate.alias("rate"), part.alias("part"))

    def one(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("size", "descending"), ("cut", "ascending")]))
        return t.append_column("wanted", pa.array(rounded(*(t[c].to_numpy() for c in ("size", "rate", "n")), most)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", wanted long"
    wanted = kept(classes.groupBy("key", "part").applyInArrow(one, schema))
    wanted = wanted.select("key", "size", "cut", "source_size", "target", "rate", F.floor(F.col("wanted") / F.col("n")).alias("each"), (F.col("wanted") % F.col("n")).alias("more"))
    # copies go to all documents of a class alike, and what is left over to the first by hash
    turn = F.row_number().over(Window.partitionBy("key", "size", "cut").orderBy("hash"))
    rows = rows.select("given", "key", "size", "cut", turn.alias("turn")).join(wanted, ["key", "size", "cut"])
    copies = (F.col("each") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)).cast("long")
    out = rows.select("given", "size", "source_size", "target", "rate", copies.alias("copies"))
    return out.select(*[F.col("given")[c].alias(c) for c in names], "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


RESULTS = {"size", "source_size", "target", "rate", "copies", "taken"}


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("words"))
    return mix(docs, text="words", size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")
