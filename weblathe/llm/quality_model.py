"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts of the whole text, made by one projection. On the driver, a bounded sample of labelled rows is
binned by quantiles, and shallow trees on one feature at a time are boosted in cycles; a feature's trees add up to one
lookup table over its bins. Then the pairs of features that explain most of what is left get tables of their own, from trees that cut both once.
A text's score is the logistic of the sum of its bins' entries, so scoring is a search and an addition a feature.

Labels are learned only from rows with crc32(doc_id) mod 5 other than 0; of these a hash of the id picks about SAMPLE
rows, and all where there are fewer. Labels, language, source and id are no features. Rows without a label value
are left out; repeated labels count repeatedly. Without rows to learn from every score is 0.5, and with one class only its
smoothed share. Null and empty texts are scored as texts without words. Null ids are not held out. Repeated rows are scored alike; an
empty table gives no rows. Other columns pass through `score` unless their names are those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import table
from weblathe.llm.quality_rules import counts

#: Labelled rows to learn from, about.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.1, 5.0
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: Column) -> dict[str, Column]:
    """Columns to add in two steps: the counts, and the features made of them."""
    t = F.coalesce(text, F.lit(""))
    more = {
        "n_bytes": F.octet_length(t).cast("long"),
        "n_upper": F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long"),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
        "n_marks": F.regexp_count(t, F.lit("[.,;:]")).cast("long"),
        "n_shouts": F.regexp_count(t, F.lit("[!?]")).cast("long"),
    }
    return counts(text) | more


def measured() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "log_words": F.log1p("n_words"),
        "word_chars_mean": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "stop_share": per("n_stop_words", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "words_a_line": per("n_words", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "mark_share": per("n_marks", "n_words"),
        "shout_share": per("n_shouts", "n_words"),
        "bytes_a_char": per("n_bytes", "word_chars"),
    }


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """given (the columns of docs but text) and x, all features."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c.lower() != text.lower()]).alias("given"), F.col(text).alias("t")).withColumns(features(F.col("t")))
    return rows.select("*", "of_words.*", "of_lines.*").select("given", F.array(*[c.cast("double") for c in measured().values()]).alias("x"))


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, a, b, t in self.pairs:
            out += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logit(x))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h):
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
    """The leaf value of each bin, of a tree that cuts the bins up to so many times where it gains most."""
    spans = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gains = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], s, a + k + 1)
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def crossed_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Its gain and the leaf value of each cell, of the tree that cuts both features once."""
    cg, ch = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
    best = (0.0, np.zeros_like(g))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            tg, th = cg[-1, -1], ch[-1, -1]
            sums = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]), (tg - cg[i, -1] - cg[-1, j] + cg[i, j], th - ch[i, -1] - ch[-1, j] + ch[i, j])]
            gain = sum(_gain(a, b) for a, b in sums)
            if gain > best[0]:
                leaf = np.zeros_like(g)
                for p, (a, b) in zip(parts, sums):
                    leaf[p] = a / (b + RIDGE)
                best = (gain, leaf)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    z = np.full(len(y), model.base)
    model.edges = [quantiles(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables):
            p = _logistic(z)
            step = RATE * shallow_tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            z += step[b]
    coarse = [quantiles(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    size = [len(e) + 1 for e in coarse]

    def tree(i, j):
        p, at, n = _logistic(z), cells[i] * size[j] + cells[j], size[i] * size[j]
        g, h = (np.bincount(at, v, n).reshape(size[i], size[j]) for v in (y - p, p * (1 - p)))
        return crossed_tree(g, h)

    ranked = sorted(((tree(i, j)[0], i, j) for i, j in combinations(range(len(size)), 2)), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((size[i], size[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, t in model.pairs:
            step = RATE * tree(i, j)[1]
            t += step
            z += step[cells[i], cells[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents(doc_id, text) and labels(doc_id, quality)."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("y"))
    n = usable.count()
    part = 2**31 * min(1.0, sample / max(1, n))
    picked = usable.filter(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(2**31)) < part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about sample rows of two numbers
    got = with_features(rows.select("y", "text")).select("given.y", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(measured()))
    order = np.lexsort((got["y"], *x.T)) if len(x) else []  # sums don't depend on the order of partitions
    return fit(x[order] if len(x) else x, got["y"].to_numpy(float)[order] if len(x) else np.zeros(0))


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """docs, without text, with score and predicted."""
    names = [c for c in docs.columns if c.lower() not in (text.lower(), "score", "predicted")]
    rows = with_features(docs.select(*names, F.col(text).alias(text)), text)
    schema = T.StructType([rows.schema["given"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(max(1, batch.num_rows), -1)[: batch.num_rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["given", "score"])

    return rows.mapInArrow(run, schema).select(*[F.col("given")[c].alias(c) for c in names], "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
