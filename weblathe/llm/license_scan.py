"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and of all other than ASCII characters, A-Z lower-cased. A block is a line,
or a window of consecutive words over the ends of lines, without a line that has no words between them, that is a fifth longer
than the template (SLACK); a window starts in the line that it is counted for. Of a template's windows that overlap the best is kept.
A template fits a block when the block has at least CONTAINMENT of the template's distinct words. The join is exact:
the words of the templates get one global order, rarest in the corpus first, and a block is the sorted places of its template words in it.
An inverted index from places to the templates that have them in their prefix gives the candidates (prefix filter); a block needs
as many template words as a candidate asks for (length filter), and as many from the first shared one on, as those before it aren't
the template's (positional filter). All that survives is counted exactly.
Templates, order and index are tables of constants, so the probe runs inside each row: nothing is exploded or shuffled but the counts of
template words, of which there is one row a word.

Null and empty texts have no words and no labels. Rows are judged alone; repeated rows, ties and null ids stay as they
are, and an empty table gives no rows. Other columns pass through unless their names are those of the results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.llm.common import let, table

_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The same as _IN; characters that are listed one by one are looked up in a table.
_LISTED = "[\\x{80}-\\x{10FFFF}0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz]"
CONTAINMENT = 0.8
#: How much longer than a template's words a window over several lines is: wrapped notices may have other words between their own.
SLACK = 1.2
#: The base phrases.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of well-known licenses and their notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("agpl-3", "you should have received a copy of the gnu affero general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
)


def _phrase(phrase: str) -> str:
    """A pattern of the phrase's words, consecutive and whole; Java's (?i) folds A-Z only."""
    return rf"(?i)(?<!{_IN})" + rf"{_OUT}+".join(phrase.split()) + rf"(?!{_IN})"


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_LISTED + "+")).cast("long")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), _OUT + "+"), "")


def word_counts(docs: DataFrame, text: str, templates=TEMPLATES) -> dict[str, int]:
    """In how many texts each template word occurs, to order them; one row a template word comes to the driver."""
    known = sorted({w for _, t in templates for w in t.split()})
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _OUT + "+")
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, known)))).alias("w"))
    counted = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in known}


class Tables:
    """The templates by their words' places (from 1) in the global order, and the index of their prefixes, as constant columns."""

    def __init__(self, templates, counts: dict[str, int], containment: float):
        order = sorted(counts, key=lambda w: (counts[w], w))
        place = {w: i + 1 for i, w in enumerate(order)}
        rows, holders = [], [[] for _ in order]
        for k, (label, text) in enumerate(templates):
            at = sorted({place[w] for w in text.split()})
            needed = math.ceil(containment * len(at) - 1e-9)
            prefix = at[: len(at) - needed + 1]
            rows.append(F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.lit(int(SLACK * len(text.split()))).alias("window"), F.lit(needed).alias("needed"), F.array(*map(F.lit, at)).alias("at"), F.array(*map(F.lit, prefix)).alias("prefix")))
            for i in prefix:
                holders[i - 1].append(k + 1)
        self.longest = max((int(SLACK * len(t.split())) for _, t in templates), default=0)
        self.rare = [w for w, held in zip(order, holders) if held]
        self.words, self.templates = F.array(*map(F.lit, order)), F.array(*rows)
        self.index = F.array(*[F.array(*map(F.lit, held)).cast("array<int>") for held in holders])

    def places(self, words: Column) -> Column:
        """The sorted places of the template words among these words."""
        return F.array_sort(F.transform(F.array_intersect(words, self.words), lambda w: F.array_position(self.words, w).cast("int")))

    def candidates(self, places: Column) -> Column:
        """The templates that have one of these places in their prefix."""
        found = F.array_distinct(F.flatten(F.transform(places, lambda i: F.element_at(self.index, i))))
        return F.transform(found, lambda k: F.element_at(self.templates, k))

    @staticmethod
    def overlap(m: Column, places: Column) -> Column:
        """How many of the template's words a block has; 0 where a filter says that too few can be."""
        first = F.array_min(F.array_intersect(places, m["prefix"]))
        left = F.size(F.filter(places, lambda i: i >= first))
        fits = F.coalesce((F.size(places) >= m["needed"]) & (left >= m["needed"]), F.lit(False))
        return F.when(fits, F.size(F.array_intersect(places, m["at"]))).otherwise(0)


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, line, overlap, score).

    score: 1 with a base label, else the greatest containment of a template that fits, else 0.
    """
    made = Tables(templates, word_counts(docs, text, templates), containment)
    names = [c for c in docs.columns if c.lower() not in RESULTS or c.lower() == text.lower()]
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("given"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    docs = docs.select("*", F.lower("t").alias("low"))  # of other than ASCII characters only more may be made alike
    t, low = F.col("t"), F.col("low")

    def place(phrase: str) -> Column:
        p = _phrase(phrase)
        found = F.struct(
            F.regexp_count(t, F.lit(p)).cast("long").alias("n"),
            _count_words(F.regexp_extract(t, r"(?s)\A(.*?)" + p, 1)).alias("first"),
            _count_words(F.regexp_extract(t, r"(?s)\A(.*)" + p, 1)).alias("last"),
        )
        return F.when(reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in phrase.split()]) & t.rlike(p), found)

    def fits(line: Column, number: Column) -> Column:
        one = lambda m, places: let(made.overlap(m, places), lambda o: F.when(o >= m["needed"], _hit(m, o, number)))
        return let(made.places(F.array_distinct(_words(line))), lambda places: F.array_compact(F.transform(made.candidates(places), lambda m: one(m, places))))

    def wrapped(lines: Column, start: Column) -> Column:
        """The templates that fit the windows from line start on, of more than one line."""
        near = _words(F.array_join(F.transform(F.slice(lines, start + 1, made.longest + 1), lambda x: x["x"]), "\n"))
        return let(made.candidates(made.places(near)), lambda ms: F.array_compact(F.transform(F.filter(ms, lambda m: m["window"] > 1), lambda m: _wrapped(m, lines, start))))

    def _wrapped(m: Column, lines: Column, start: Column) -> Column:
        def add(a, x):
            more = a["open"] & (a["n"] < m["window"]) & (x["n"] > 0)
            return F.when(more, F.struct((a["n"] + x["n"]).alias("n"), (a["size"] + 1).alias("size"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["size"].alias("size"), F.lit(False).alias("open")))

        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("size"), F.lit(True).alias("open"))
        size = F.aggregate(F.slice(lines, start + 2, m["window"]), none, add, lambda a: a["size"])

        def hit(block: Column) -> Column:
            n = F.element_at(block, 1)["n"].cast("int")
            spots = F.sequence(F.greatest(F.lit(1), n - m["window"] + 2), n)
            most = lambda words: F.array_max(F.transform(spots, lambda at: made.overlap(m, made.places(F.slice(words, at, m["window"])))))
            text = lambda lines: F.array_join(F.transform(lines, lambda x: x["x"]), "\n")
            # The window ends where it has all these words, so that it leaves the lines of the next notice alone.
            enough = lambda o: F.array_min(F.filter(F.sequence(F.lit(1), F.size(block)), lambda s: made.overlap(m, made.places(_words(text(F.slice(block, 1, s))))) >= o))
            kept_as = lambda o: F.when(o >= m["needed"], F.struct(m["k"].alias("k"), (start + F.coalesce(enough(o), F.size(block)) - 1).alias("end"), _hit(m, o, start).alias("match")))
            # The whole of the lines first: most have too few of the words.
            found = lambda words: F.when(made.overlap(m, made.places(words)) >= m["needed"], let(most(words), kept_as))
            return F.when((F.size(block) > 1) & F.exists(block, lambda x: x["hit"]), let(_words(text(block)), found))

        return let(F.slice(lines, start + 1, size), hit)

    def best(found: Column) -> Column:
        """Windows of a template that don't overlap: the one with most words, then of fewest lines, then the first, is chosen again and again among those that are left."""
        ranked = lambda h: F.struct((-h["match"]["overlap"]).alias("o"), (h["end"] - h["match"]["line"]).alias("l"), h["match"]["line"].alias("at"), h["k"].alias("k"), h["end"].alias("end"), h["match"].alias("match"))
        order = F.array_sort(F.transform(found, ranked))
        clear = lambda chosen, h: ~F.exists(chosen, lambda g: (g["k"] == h["k"]) & (g["at"] <= h["end"]) & (h["at"] <= g["end"]))
        chosen = let(order, lambda o: F.aggregate(o, F.slice(o, 1, 0), lambda kept, h: F.when(clear(kept, h), F.concat(kept, F.array(h))).otherwise(kept)))
        return F.transform(chosen, lambda h: h["match"].withField("end", h["end"]))

    def plain(found: Column) -> Column:
        return F.transform(found, lambda h: h.dropFields("end"))

    def _hit(m: Column, o: Column, number: Column) -> Column:
        return F.struct(m["label"].alias("label"), number.cast("long").alias("line"), o.cast("long").alias("overlap"), (o / F.size(m["at"])).alias("score"))

    # A text or line without any prefix word has no candidate.
    rare = r"(?i)(?<!%s)(?:%s)(?!%s)" % (_IN, "|".join(sorted(made.rare)), _IN)
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in made.rare], F.lit(False))
    some &= F.arrays_overlap(F.split(low, _OUT + "+"), F.array(*map(F.lit, made.rare)))
    candidates = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(rare))
    nothing = F.array().cast("array<struct<label:string,line:bigint,overlap:bigint,score:double>>")
    single = F.flatten(F.transform(candidates, lambda s: fits(s["x"], s["i"])))
    lines = F.transform(F.split(t, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"), _count_words(x).alias("n"), x.rlike(rare).alias("hit")))
    # A window from a line on has at most as many lines more as the longest window has words.
    reach = made.longest + 1
    near = lambda ls: F.filter(ls, lambda s: (s["n"] > 0) & F.exists(F.slice(ls, s["i"] + 1, reach), lambda x: x["hit"]))
    several = let(lines, lambda ls: let(F.flatten(F.transform(near(ls), lambda s: wrapped(ls, s["i"]))), best))
    # Lines that fit alone need no window over them.
    covered = lambda w, alone: F.exists(alone, lambda a: (a["label"] == w["label"]) & (a["score"] >= w["score"]) & a["line"].between(w["line"], w["end"]))
    matches = F.when(some, let(single, lambda alone: F.concat(alone, let(several, lambda ws: plain(F.filter(ws, lambda w: ~covered(w, alone))))))).otherwise(nothing) if templates else nothing

    out = docs.select("given", F.array(*[place(p) for p in PHRASES]).alias("places"), matches.alias("matches"), _count_words(t).alias("n_words"))
    at = [F.get("places", F.lit(i)) for i in range(len(PHRASES))]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(label)) for c, label in zip(at, PHRASES.values())]))))
    n_base = sum((F.coalesce(c["n"], F.lit(0)) for c in at), F.lit(0)).cast("long")
    found = F.array_sort(F.array_distinct(F.concat(base, F.transform("matches", lambda m: m["label"]))))
    highest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    results = {
        "n_words": F.col("n_words"), "n_base": n_base, "first_word": F.array_min(F.array(*[c["first"] for c in at])), "last_word": F.array_max(F.array(*[c["last"] for c in at])),
        "base_labels": F.array_join(base, ","), "labels": F.array_join(found, ","), "score": F.when(n_base > 0, 1.0).otherwise(highest), "matches": F.col("matches"),
    }
    return out.select(*[F.col("given")[c].alias(c) for c in names if c.lower() not in RESULTS], *[c.alias(k) for k, c in results.items()])


RESULTS = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"}


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    cases = " UNION ALL ".join(
        f"SELECT r, s.i, '{label}' AS label FROM s WHERE " + " AND ".join(f"w[s.i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    known = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
s AS MATERIALIZED (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM e WHERE list_has_any(w, ['mit', 'apache', 'cc'])),
p AS ({cases}),
b AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS l FROM p GROUP BY r),
k(id, label, words) AS (VALUES {known}),
x AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM e),
c AS (SELECT r, label, len(list_intersect(x.w, words))::DOUBLE / len(words) AS score FROM x, k),
m AS (SELECT r, max(score) AS score, list(DISTINCT label) AS l FROM c WHERE score >= {CONTAINMENT} - 1e-9 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.l, []) || coalesce(m.l, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.score, 0.0) END::DOUBLE AS score
FROM e LEFT JOIN b ON e.r = b.r LEFT JOIN m ON e.r = m.r
"""


ORACLE_SQL = _oracle()
