"""URL filters by a Bloom filter cascade.

A rule is a key, `host/path`, with a verdict. A url has as many keys as there are suffixes of its host and lengths of
rules' paths, and the longest key that is a rule decides. The keys of all urls of the corpus are the cascade's
universe: level 1 encodes the rules of one verdict; level 2 the other keys of the universe that level 1 takes for rules;
level 3 the rules that level 2 takes for such keys; and so on until nothing is left. A key of the universe is a rule
exactly if the first level that lacks it is even, so that urls are judged without a join.

Level 1 is sized so that its false positives over the universe are about as many as the rules, so all levels together
grow with the rule list and not with the corpus. Which keys of the universe are rules is told by the aggregation that makes them distinct.
Levels are built where the keys are, each in ranges of its bits, and shipped to the tasks up to MAX_BYTES a level; rules that need
more are looked up by a join of the keys instead.

Null urls and urls without `://` have an empty host and path and meet no rule. Rows are judged alone; repeated rows and
null ids stay. An empty table, or an empty rule list, works. Other columns pass through unless their names are those of
the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import kept, table
from weblathe.llm.shingles import mix

MAX_BYTES = 64 << 20
#: Words of 64 bits that are put together in one row.
RANGE = 1 << 13
#: Of all levels but the first.
RATE = 0.5
#: The rules of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of a url, longest first: each suffix of the host with each start of the path that has a rule's length."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    longest = F.sort_array(F.transform(pairs, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))), asc=False)
    return F.when(host != "", F.transform(longest, lambda s: s["key"])).otherwise(F.array().cast("array<string>"))


def places(a: np.ndarray, b: np.ndarray, salt: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of keys in a level; each level has hash functions of its own."""
    a, b = mix(a + np.uint64(salt)), mix(b ^ np.uint64(salt)) | np.uint64(1)
    for i in range(hashes):
        yield mix(a + np.uint64(i) * b) % np.uint64(bits)


@dataclass
class Level:
    bits: np.ndarray
    hashes: int
    salt: int = 0

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in places(a, b, self.salt, self.hashes, len(self.bits) * 8):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def size_of(n: int, rate: float) -> int:
    """Bytes of a level of n keys."""
    return max(8, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2 / 8))


def level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the n rows (a, b) of keys; a task sends its own bits, ranges of them are put together, and the driver gets a row a range."""
    size = size_of(n, rate)
    if size > MAX_BYTES:
        raise ValueError(f"a level of {size} bytes; the limit is {MAX_BYTES}")
    hashes = max(1, round(-math.log2(rate)))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for x in batches:
            a, b = (x.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            own = np.unique(np.concatenate([own, *(e.astype(np.int64) for e in places(a, b, salt, hashes, size * 8))]))
        word = own >> 6
        bit = np.left_shift(np.uint64(1), (own & 63).astype(np.uint64))
        if len(own):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(np.bitwise_or.reduceat(bit, starts).view(np.int64))], names=["word", "bits"])

    def together(t: pa.Table) -> pa.Table:
        word, bits = (t[c].to_numpy() for c in ("word", "bits"))
        out = np.zeros(RANGE, np.uint64)
        np.bitwise_or.at(out, word % RANGE, bits.view(np.uint64))
        return pa.table({"part": pa.array([int(word[0]) // RANGE]), "bits": pa.array([out.tobytes()], pa.binary())})

    words = keys.select("a", "b").mapInArrow(positions, "word long, bits long")
    parts = words.groupBy(F.shiftright("word", RANGE.bit_length() - 1)).applyInArrow(together, "part long, bits binary").collect()  # of at most MAX_BYTES
    out = np.zeros(-(-size // 8 // RANGE) * RANGE + RANGE, np.uint64)
    for r in parts:
        out[r["part"] * RANGE : (r["part"] + 1) * RANGE] = np.frombuffer(r["bits"], np.uint64)
    return Level(out.view(np.uint8)[:size], hashes, salt)


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that it was built over."""
        first_lack = np.full(len(a), len(self.levels) + 1)
        for i in range(len(self.levels), 0, -1):
            first_lack[~self.levels[i - 1].has(a, b)] = i
        return first_lack % 2 == 0


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(3), key).alias("a"), F.xxhash64(F.lit(5), key).alias("b")]


def build(listed: DataFrame, others: DataFrame, n_listed: int, n_others: int) -> Cascade:
    """Of distinct (a, b): the listed keys of the universe, and all others. Only level 1 is tested over the others; what it lets through is as small as the list."""
    if not n_listed:
        return Cascade([Level(np.zeros(8, np.uint8), 1)])
    levels = [level(listed, n_listed, first_rate(n_listed, n_others), 0)]
    inside, outside = listed, kept(passing(others, levels[0]))
    while n := outside.count():
        if len(levels) > 60:
            raise RuntimeError("two keys have the same 128 bits of hashes")
        levels.append(level(outside, n, RATE, len(levels)))
        inside, outside = outside, kept(passing(inside, levels[-1]))
    return Cascade(levels)


def first_rate(n_listed: int, n_others: int) -> float:
    return min(RATE, max(1e-9, n_listed * math.sqrt(0.5) / max(1, n_listed + n_others)))


def passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (x.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            yield x.filter(pa.array(level.has(a, b)))

    return keys.select("a", "b").mapInArrow(run, "a long, b long")


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (host/path, allow or block); of repeated keys block wins."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    rules = kept(rules.select("rule", "verdict", *hashed(F.col("rule"))))
    at = F.length(F.regexp_extract("rule", r"\A[^/]*(.*)", 1))
    lengths = [r["n"] for r in rules.select(at.alias("n")).distinct().collect()]  # lengths of paths, a short list
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c.lower() == url.lower()]
    out = pages.select(F.struct(*[F.col(c) for c in names]).alias("given"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    out = out.withColumn("keys", keys(F.col("host"), F.col("path"), lengths))
    flags = {"used": F.lit(False), "allow": F.col("verdict") == "allow", "block": F.col("verdict") == "block"}
    ours = out.select(F.explode("keys").alias("key")).select(*hashed(F.col("key")), F.lit(True).alias("used"), F.lit(False).alias("allow"), F.lit(False).alias("block"))
    every = ours.unionByName(rules.select("a", "b", *[c.alias(k) for k, c in flags.items()])).groupBy("a", "b").agg(*[F.max(k).alias(k) for k in flags])
    universe = kept(every.filter("used").drop("used"))
    count = universe.agg(F.count(F.lit(1)).alias("n"), F.count_if("allow").alias("allow"), F.count_if("block").alias("block")).first()
    if any(size_of(count[v], first_rate(count[v], count["n"] - count[v])) > max_bytes for v in ("allow", "block")):
        judged = _joined(out, rules, default)
    else:
        cascades = {v: build(universe.filter(v).select("a", "b"), universe.filter(~F.col(v)).select("a", "b"), count[v], count["n"] - count[v]) for v in ("allow", "block")}
        judged = _tested(out, cascades, default)
    return judged.select(*[F.col("given")[c].alias(c) for c in names if c.lower() not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")


def _tested(out: DataFrame, cascades: dict[str, Cascade], default: str) -> DataFrame:
    """Rules and verdicts by the cascades alone; Spark broadcasts them with the function."""
    hashes = F.transform("keys", lambda k: F.struct(*hashed(k)))
    tested = out.select("given", "host", "path", "keys", F.transform(hashes, lambda s: s["a"]).alias("a"), F.transform(hashes, lambda s: s["b"]).alias("b"))
    schema = T.StructType([*tested.select("given", "host", "path").schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists, a, b = (x.column(3 + i) for i in range(3))
            a, b = (v.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for v in (a, b))
            allow, block = cascades["allow"].has(a, b), cascades["block"].has(a, b)
            row = lists.value_parent_indices().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(allow | block)
            first = hit[np.unique(row[hit], return_index=True)[1]]  # keys stand longest first
            take = np.full(x.num_rows, -1)
            take[row[first]] = first
            index = pa.array(take, mask=take < 0)
            verdict = np.where(take < 0, default, np.where(block[take] if len(block) else False, "block", "allow"))
            yield pa.RecordBatch.from_arrays([*x.columns[:3], lists.flatten().take(index), pa.array(verdict.tolist(), pa.string())], names=["given", "host", "path", "rule", "verdict"])

    return tested.mapInArrow(run, schema)


def _joined(out: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join of all keys with the rules."""
    numbered = kept(out.withColumn("row", F.monotonically_increasing_id()))
    hits = numbered.select("row", F.posexplode("keys").alias("at", "rule")).join(rules.select("rule", "verdict"), "rule")
    best = hits.groupBy("row").agg(F.min_by(F.struct("rule", "verdict"), "at").alias("best"))
    return numbered.join(best, "row", "left").select("given", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = f"""
WITH r(rule, verdict) AS (VALUES {", ".join(map(str, RULES))}),
s AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r),
u AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(coalesce(url, ''), '^(?:.|\\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN s ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.n = m.n
"""
