"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Null and empty texts have no words; they fail the base rule, as every text of under ten words does. Ties and
repeated rows don't matter: each row is judged alone. Columns of the input are kept as they are, except that a
column of the same name as one of the results is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.llm.common import SPACES, let, table, without, words

#: Languages that STOP_WORDS has, and their script.
LANGUAGES = ("en", "de", "fr", "es")
LATIN = r"\p{IsLatin}"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by are from this an at "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als "
    "le la les de et des en un une du que est pour qui dans sur par au avec ne pas "
    "el los las y del se con por su para al lo como más o es"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= measure <= high; texts of fewer than at_least words aren't judged by it."""

    measure: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0


#: Mean word length in code points; symbols a word; share of stop words; share of lines that repeat; characters a line.
THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 20.0),
    Threshold("symbols_per_word", high=0.2),
    Threshold("stop_word_share", low=0.01, at_least=60),
    Threshold("repeated_line_share", high=0.5),
)


def counts(text: Column) -> dict[str, Column]:
    """The whole-text counts that the measures are made of; of_words and of_lines split the text once for several."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "word_chars": F.char_length(without(text, SPACES)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    }


def repeated_words(w: Column) -> Column:
    """How many of the words w lie in a window that occurs at least twice.

    Windows are compared by 64-bit fingerprints. Only texts with a repeat sort their windows: equal ones become
    neighbours, and the sorted starts of those say how many words each adds to the ones before it.
    """
    size = F.size(w)
    fingerprint = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    windows = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), size - WINDOW), fingerprint))
    return F.when(size < WINDOW, 0).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    )


def _covered(h: Column) -> Column:
    by_value = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    same = lambda s, a, j: F.coalesce(F.get(s, j)["v"] == a["v"], F.lit(False))
    starts = let(by_value, lambda s: F.transform(s, lambda a, j: F.when(same(s, a, j - 1) | same(s, a, j + 1), a["i"])))
    added = lambda p: F.transform(p, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - a, F.lit(WINDOW))))
    return let(F.sort_array(F.array_compact(starts)), lambda p: F.aggregate(added(p), F.lit(0), lambda x, y: x + y))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept")


def measures() -> dict[str, Column]:
    """From the columns of counts()."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "repeated_line_share": per("n_dup_lines", "n_lines"),
    }


def unlisted(text: Column, lang: Column | None = None) -> Column:
    """Whether a text's language has no stop words here: by lang where it is known, and texts mostly of other than Latin letters."""
    text = F.coalesce(text, F.lit(""))
    other = 2 * F.regexp_count(text, F.lit(LATIN)) < F.regexp_count(text, F.lit(r"\p{L}"))
    if lang is None:
        return other
    return ~F.coalesce(F.regexp_extract(F.lower(lang), "^([a-z]*)", 1).isin("", *LANGUAGES), F.lit(True)) | other


def compiled(thresholds=THRESHOLDS, no_stop_words: Column | None = None) -> Column:
    """Whether a text passes all thresholds; that of stop words isn't asked where no_stop_words."""
    known, passes = measures(), F.lit(True)
    for t in thresholds:
        bound = F.lit(True)
        if t.low is not None:
            bound &= known[t.measure] >= t.low
        if t.high is not None:
            bound &= known[t.measure] <= t.high
        bound |= F.col("n_words") < t.at_least
        if t.measure == "stop_word_share" and no_stop_words is not None:
            bound |= no_stop_words
        passes &= bound
    return passes


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, lang: str = "lang") -> DataFrame:
    """docs with the counts, base_failed and kept. The column lang is used where docs has it."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    names = [c for c in docs.columns if c.lower() not in RESULTS or c.lower() == text.lower()]
    given = F.col("given")
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("given"), *[c.alias(k) for k, c in counts(F.col(text)).items()])
    rows = rows.select("*", "of_words.*", "of_lines.*").withColumn("base_failed", (n < 10) | (100 * repeated > 20 * n))
    rows = rows.withColumn("kept", ~F.col("base_failed") & compiled(thresholds, unlisted(given[text], given[lang] if lang in names else None)))
    return rows.select(*[given[c].alias(c) for c in names if c.lower() not in RESULTS], *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(out)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i+4], ' ')) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM s)),
m AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range(0, 5) AS o(k) WHERE n > 1 GROUP BY r),
c AS (SELECT s.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop,
  2 * len(regexp_extract_all(t, '\\p{{Latin}}')) < len(regexp_extract_all(t, '\\p{{L}}')) AS unlisted, coalesce(m.n, 0) AS n_repeat_words
  FROM s LEFT JOIN m ON s.r = m.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND word_chars / greatest(n_words, 1) >= 2.0 AND word_chars / greatest(n_words, 1) <= 20.0
  AND n_symbols / greatest(n_words, 1) <= 0.2
  AND (n_stop / greatest(n_words, 1) >= 0.01 OR n_words < 60 OR unlisted)
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM c
"""
