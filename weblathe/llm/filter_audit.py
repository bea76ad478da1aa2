"""Which documents each filter removes under every order of the filters, and each filter's Shapley share.

A document's failures are a mask with one bit a filter, so all orders depend on one small table only: how many documents of a part
have each mask (its cells). Documents are reduced to cells by aggregations; nothing but cells leaves the JVM. The orders of a part are then
walked by adjacent transpositions, each order differing from the one before in two neighbouring steps: only these two are counted again from the
cells, and every filter's removals are summed along the walk.

A filter is a Column over the text, or REPEATS: the text is identical to that of a smaller doc_id anywhere in the table. Identity is that of
the texts' SHA-256. The smallest id of each text comes from one aggregation; rows find out whether they are it by a join on (text, id), in which a text
of a third of all rows is spread over its ids. Rows that are alike in all of this are one row with a count before any join.

Null texts count as empty, null parts as ''. A null doc_id is neither smaller nor larger than others, so that such a row never fails REPEATS and makes no other
row fail; it has no labels. Rows that repeat id and text are counted each and don't make each other fail. A document is good or toxic where any of
its labels says 1; null labels say nothing. An empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.llm.common import kept, let, table, words

#: Instead of a Column: the text is that of a smaller doc_id too.
REPEATS = "repeats"
#: Orders of more filters than these are too many to list.
MOST = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filters(text: Column) -> dict[str, Column | str]:
    """The contract's five filters over a text that isn't null."""
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": 100 * upper > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"), "E": REPEATS,
    }


def failures(docs: DataFrame, tests=filters, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, digest, part, mask of all filters but REPEATS, and n, how many rows are alike in these."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sizes = let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    rows = rows.withColumn("s", sizes).select("doc_id", "part", "t", "s.*")
    mask = F.lit(0)
    for k, test in enumerate(tests(F.col("t")).values()):
        if isinstance(test, Column):
            mask = mask + F.when(test, 1 << k).otherwise(0)
    rows = rows.select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), "part", mask.cast("int").alias("mask"))
    return rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, tests=filters, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    kinds = list(tests(F.lit("")).values())
    repeats = sum(1 << k for k, x in enumerate(kinds) if not isinstance(x, Column))
    rows = kept(failures(docs, tests, doc_id, text, part))
    told = labels.filter(F.col(doc_id).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    told = told.groupBy(F.col(doc_id).alias("doc_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.filter("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    named = named.withColumn("mask", F.col("mask") + F.when(F.col("first").isNull(), repeats).otherwise(0))
    nameless = rows.filter("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    both = named.select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(nameless)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def walk(n: int) -> Iterator[int]:
    """Places whose neighbours to swap one after another, so that all orders of n things are visited once: the last thing goes to and fro through the others'
    orders, which change by a swap whenever it has arrived at an end."""
    if n < 2:
        return
    below, down = walk(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(below, None)
        if swap is None:
            return
        yield swap + 1 if down else swap  # the last thing is in front of the others, or behind them
        down = not down


def orders(letters: list[str], held: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """All orders of the filters with the counts of their steps. held: [part, mask, (n, good, toxic)]; counts: [step, part, (kept, removed, redundant, good, toxic)]."""
    masks = np.arange(1 << len(letters))
    order, before = list(range(len(letters))), 0

    def step(f: int, earlier: int) -> np.ndarray:
        fails, gone = (masks >> f & 1).astype(bool), (masks & earlier) > 0
        lost = held[:, fails & ~gone].sum(1)
        left = held[:, ~fails & ~gone, 0].sum(1)
        return np.stack([left, lost[:, 0], held[:, fails & gone, 0].sum(1), lost[:, 1], lost[:, 2]], 1)

    counts = np.zeros((len(letters), len(held), 5), np.int64)
    for i, f in enumerate(order):
        counts[i] = step(f, before)
        before |= 1 << f
    yield order, counts
    for at in walk(len(letters)):
        order[at], order[at + 1] = order[at + 1], order[at]
        before = sum(1 << f for f in order[:at])
        counts[at], counts[at + 1] = step(order[at], before), step(order[at + 1], before | 1 << order[at])
        yield order, counts


def audited(t: pa.Table, letters: list[str]) -> pa.Table:
    """The rows of some parts: part and cells (mask, n, good, toxic) of each."""
    parts, k = t.column("part").to_pylist(), len(letters)
    held = np.zeros((len(parts), 1 << k, 3), np.int64)
    for p, found in enumerate(t.column("cells").to_pylist()):
        for c in found:
            held[p, c["mask"]] += (c["n"], c["good"], c["toxic"])
    only = np.stack([held[:, 1 << f, 0] for f in range(k)], 1)
    shapley, names, chosen, got = np.zeros((k, len(parts)), np.int64), [], [], []
    for order, counts in orders(letters, held):
        for i, f in enumerate(order):
            shapley[f] += counts[i, :, 1]
        names.append("".join(letters[f] for f in order)), chosen.append(list(order)), got.append(counts.copy())
    made = np.stack(got)  # [order, step, part, count]
    chosen = np.array(chosen)
    shape = made.shape[:3]
    flat = lambda x: pa.array(np.ascontiguousarray(np.broadcast_to(x, shape)).ravel())
    places = np.arange(len(parts))[None, None, :]
    columns = {
        "part": pa.array(parts, pa.string()).take(flat(places)), "filter_order": pa.array(names).take(flat(np.arange(len(names))[:, None, None])),
        "step": flat(np.arange(1, k + 1, dtype=np.int32)[None, :, None]), "kept": flat(made[..., 0]), "removed": flat(made[..., 1]), "redundant": flat(made[..., 2]),
        "unique_fails": flat(only[places, chosen[:, :, None]]), "good_lost": flat(made[..., 3]), "toxic_lost": flat(made[..., 4]),
        "shapley": flat(shapley[chosen[:, :, None], places]),
    }
    return pa.table(columns)


def audit(cells: DataFrame, letters: list[str]) -> DataFrame:
    """part, filter_order, step and COUNTS, of every part, order and step. letters: one a bit of the masks."""
    if len(letters) > MOST:
        raise ValueError(f"{math.factorial(len(letters))} orders are too many")
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** len(letters) cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                yield from audited(pa.Table.from_batches([batch.slice(at, 50)]), letters).to_batches()

    return held.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audit(cells(docs, labels), list(filters(F.lit(""))))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
s AS (SELECT o, k, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before FROM o, range(1, 6) AS r(k)),
m AS (SELECT part, o, k, x, n, c.good, c.toxic, fails = x AS alone, contains(fails, x) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM c, s),
g AS (SELECT part, o, k, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM m GROUP BY part, o, k, x)
SELECT part, o AS filter_order, k::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM g
"""
