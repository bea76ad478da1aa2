"""How far the sources of a language diverge in the terms they use.

Terms are counted a slice of texts at a time in each task, then by (language, source, term) and by (language, term). A term's counts in the sources are its
sparse vector, one entry a source that has it. Terms of a language with identical vectors add alike to every pair of sources, so pairs
are evaluated once for each distinct vector and multiplied by the number of its terms; vectors are dealt in portions, and a pair's sums over
portions are added up. The largest deviations from the language as a whole are ranked over the original terms.

Probabilities are whole numbers of billionths, p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)); all arithmetic is on whole numbers.

Null texts, languages and sources count as ''. Every row is a document, also one that repeats another; ids aren't looked at. A language without kept terms
has its pairs, of value 0, and p = q = 0. A language of one source has no pairs. An empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.llm.common import kept, small_batches, table
from weblathe.llm.shingles import text_bytes

#: Documents of its language that a kept term occurs in at least, what is added to every count, and ranks of terms that are told.
LEAST, ADDED, RANKS = 30, 5, 50
SCALE = 1_000_000_000
#: Bytes of text that are counted at a time, and distinct vectors of a portion.
SLICE, PORTION = 8_000_000, 2_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[97:123] = _TERM[128:] = True


def occurrences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, as a dictionary array, and the text that each is in."""
    data, offs = text_bytes(texts)
    low = _LOWER[data]
    inside = _TERM[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offs[:-1][np.diff(offs) > 0]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    ends = np.append((np.cumsum(inside) - inside)[starts], inside.sum()).astype(np.int64)  # among the terms' bytes alone
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return terms.dictionary_encode(), np.searchsorted(offs, starts, "right") - 1


def numbered(lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The number of each row's (lang, source), and both by number."""
    a, b = lang.dictionary_encode(), source.dictionary_encode()
    n = max(1, len(b.dictionary))
    found, at = np.unique(a.indices.to_numpy().astype(np.int64) * n + b.indices.to_numpy(), return_inverse=True)
    i, j = np.divmod(found, n)
    return at, a.dictionary.take(pa.array(i)), b.dictionary.take(pa.array(j))


def counted(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """count and df of the terms of each (lang, source) of some texts."""
    coded, text = occurrences(texts)
    group, langs, sources = numbered(lang, source)
    v = max(1, len(coded.dictionary))
    each, n = np.unique(text * v + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    text, term = np.divmod(each, v)
    pairs, at = np.unique(group[text] * v + term, return_inverse=True)
    which, term = (pa.array(x) for x in np.divmod(pairs, v))
    count, df = (np.bincount(at, w, len(pairs)).astype(np.int64) for w in (n, None))
    names = coded.dictionary.cast(pa.large_string()).cast(pa.string()).take(term)
    return pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), names, pa.array(count), pa.array(df)], names=["lang", "source", "term", "count", "df"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count (occurrences) and df (documents that have it)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= SLICE:
                yield from slice_of(held)
                held, size = [], 0
        if held:
            yield from slice_of(held)

    def slice_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        made = counted(*[t.column(c).combine_chunks() for c in ("lang", "source", "text")])
        for at in range(0, made.num_rows, 20_000):
            yield made.slice(at, 20_000)

    parts = rows.mapInArrow(run, "lang string, source string, term string, count long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, where total is N and terms is V; exact."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.call_function("div", over, (total + ADDED * terms).cast("decimal(20,0)")) + 1


def probabilities(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As probability, where total is N + 5 * V, by long division in three digits of a thousand: exact for totals below 9 * 10^15."""
    whole, rest = np.divmod(counts + ADDED, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def deviations(vectors: pa.Table, sources: pa.Table) -> pa.Table:
    """a, b and value: of each pair of sources (by number, a < b), the sum over vectors of n * |p_a - p_b|.

    vectors: parts (array of source, count) and n; sources: no, source, total (N + 5 * V). At most about a million probabilities are held at a time.
    """
    order = np.argsort(sources.column("no").to_numpy())
    names = {s: i for i, s in enumerate(sources.column("source").take(pa.array(order)).to_pylist())}
    no, total = sources.column("no").to_numpy()[order], sources.column("total").to_numpy()[order]
    k, rows = len(no), vectors.num_rows
    value = np.zeros((k, k), np.int64)
    step = max(1, 1_000_000 // k)
    for at in range(0, rows, step):
        part = vectors.slice(at, step).combine_chunks()
        lists, n = part.column("parts").combine_chunks(), part.column("n").to_numpy()
        where = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        inner = lists.flatten()
        column = np.array([names[s] for s in inner.field("source").to_pylist()], np.int64)
        counts = np.zeros((len(lists), k), np.int64)
        counts[where, column] = inner.field("count").to_numpy()
        p = probabilities(counts, total[None, :])
        for a in range(k - 1):
            value[a, a + 1 :] += (np.abs(p[:, a + 1 :] - p[:, a : a + 1]) * n[:, None]).sum(0)
    a, b = np.triu_indices(k, 1)
    return pa.table({"a": no[a], "b": no[b], "value": value[a, b]})


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source))])
    per_term = term_counts(docs, text, lang, source).groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct("source", "count"))).alias("parts")
    )
    terms = kept(per_term.filter(F.col("df") >= least).drop("df"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    sums = terms.select("lang", F.explode("parts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.count").alias("n"))
    groups = named.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    groups = kept(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source"))))

    vectors = kept(terms.groupBy("lang", "parts").agg(F.count(F.lit(1)).alias("n")))
    portions = vectors.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions"))
    dealt = vectors.join(portions, "lang").withColumn("portion", F.pmod(F.xxhash64("parts"), F.col("portions")).cast("int")).drop("portions")
    wanted = groups.join(portions, "lang").select("lang", "no", "source", (F.col("n") + ADDED * F.col("v")).alias("total"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made = deviations(left, right)
        return made.add_column(0, "lang", pa.array([key[0].as_py()] * made.num_rows, pa.string()))

    found = dealt.groupBy("lang", "portion").cogroup(wanted.groupBy("lang", "portion")).applyInArrow(run, "lang string, a int, b int, value long")
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    own, other = groups.select("lang", "source", F.col("no").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    pairs = own.join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    said = terms.select("lang", F.col("term").alias("item"), "total", F.explode("parts").alias("x")).select("lang", "item", "total", F.col("x.source").alias("source"), F.col("x.count").alias("count"))
    said = said.join(groups, ["lang", "source"])
    gap = probability(F.col("count"), F.col("n"), F.col("v")) - probability(F.col("total"), F.col("n_lang"), F.col("v"))
    said = said.select("lang", "source", F.lit("term").alias("part"), "item", gap.alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    first = said.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY lang, source, term),
z AS (SELECT g.lang, g.source, k.term, k.c AS total, coalesce(c.c, 0) AS c FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(c) AS n FROM z GROUP BY lang, source),
p AS (SELECT z.lang, z.source, z.term, z.c, 1 + ({SCALE}::HUGEINT * (z.c + {ADDED})) // (s.n + {ADDED} * l.v)::HUGEINT AS p,
  1 + ({SCALE}::HUGEINT * (z.total + {ADDED})) // (l.n + {ADDED} * l.v)::HUGEINT AS q
  FROM z JOIN s ON s.lang = z.lang AND s.source = z.source JOIN l ON l.lang = z.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM t WHERE part = 'pair' OR rank <= {RANKS}
"""
