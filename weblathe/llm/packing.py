"""Packing documents into sequences along a space-filling curve.

A document's vector is hashed from its ids (each distinct id adds the signs of its hash, weighted by the root of its count) and so projected to a few
dimensions at once; coordinates are brought to the unit interval by the normal distribution function, and their place on the Hilbert curve is the
document's key. Documents are sorted by key in ranges, so that neighbours in a sequence tend to be alike, and laid end to end; cutting this line at every
multiple of the length leaves no sequence short. What remains at its end is cut into powers of two, which need no padding.

What is sorted are short rows (key, digest, id, number of ids, number of the row): places come from sums within ranges, and the driver sees one
number a range. The ids themselves are written once, next to the number of their row, and meet their places by that number. Equal documents share a key; they are told apart
by doc_id and then by the number of the row, so a group of copies spreads over ranges.

Ids are those of the tokenizer's own library, looked up once per distinct pre-token of a slice (there by tiktoken, which is quicker and gives the same ids where merges are in order of ids); texts with characters beyond a set of
letters, digits, signs and spaces that is split here as there, or with a special string, go through the library whole.

Null texts are empty; an empty text has the closing id alone. Null and repeated doc_ids are fine: null comes last among equal texts. Of rows that are equal in
text and id any may come first. An empty table gives no rows. Other columns pass through unless their names are those of the results.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import erf

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import kept, small_batches, table
from weblathe.llm.jaccard_join import slices
from weblathe.llm.shingles import mix

LENGTH, END = 2048, 1
#: Dimensions of the curve and bits of a coordinate.
DIMENSIONS, BITS = 4, 12
#: Characters of text that are encoded at a time, and pre-tokens whose ids a worker keeps at most.
SLICE, REMEMBERED = 2_000_000, 1_000_000
#: The pattern whose pre-tokens are found here.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with classes that no version of Unicode disagrees on.
KNOWN = regex.compile(r"[\x00-\x1b\x20-ȳΆ-ώЀ-ҁҊ-ӿ‐-‧‰-⁞€™]")
_SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)
RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point below 0x2200."""
    out = np.full(0x2200, _OTHER, np.uint8)
    text = "".join(map(chr, range(len(out))))
    out[[m.start() for m in KNOWN.finditer(text)]] = _SIGN
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        at = np.array([m.start() for m in regex.finditer(pattern, text)])
        out[at[out[at] == _SIGN]] = kind
    return out


def kinds(points: np.ndarray) -> np.ndarray:
    return classes()[np.minimum(points, 0x21FF)]  # the last one is of class _OTHER


def pre_tokens(points: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts, end to end, begin. points: code points; kind: their classes; firsts: where each text that isn't empty begins."""
    n = len(points)
    run = np.ones(n, bool)  # where a run of one class begins
    run[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[firsts], opens[n] = True, True
    run |= opens[:n]
    begins = run.copy()
    ends = np.append(run[1:], True)  # where a run ends
    # A run of spaces gives its last one away where something follows in the text; a blank goes to what follows.
    last = np.flatnonzero((kind == _SPACE) & ends & ~opens[1:])
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    # 's and the like, where the apostrophe stands alone in its run and takes no blank
    quote = np.flatnonzero((points == 39) & run & ends & begins[:n])
    quote = quote[~opens[quote + 1]]
    after = points[quote + 1]
    second = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
    second[opens[np.minimum(quote + 2, n)]] = 0
    one = np.isin(after, [ord(c) for c in "stmd"])
    two = ((second == ord("e")) & np.isin(after, [ord("r"), ord("v")])) | ((after == ord("l")) & (second == ord("l")))
    for at, size in ((quote[one], 1), (quote[two], 2)):
        begins[at + 1] = False
        rest = at + 1 + size
        begins[rest[rest < n]] = True
    return np.flatnonzero(begins)


def _by_rank(spec: dict):
    """A faster library's encoder of the same ids, where merging by rank is merging by the file's list: each merge makes the token of the next id."""
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in merges]
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
        return None
    import tiktoken

    # byte-level vocabularies write bytes as these characters: the printable ones as themselves, the others as those from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=GPT2, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The ids of texts as tokenizers' Tokenizer.from_file(path) gives them, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in spec["added_tokens"]]
        step = spec.get("pre_tokenizer") or {}
        plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not spec.get("normalizer")
        self.vocabulary = self.whole.get_vocab_size()
        line = self.whole.encode("\n", add_special_tokens=False).ids
        self.split = plain and spec["model"]["type"] == "BPE" and len(line) == 1
        self.line = line[0] if line else None
        self.quick = _by_rank(spec) if self.split else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of pre-tokens; those that aren't white space hold no line end and are encoded many at a time, as a line each."""
        blank = [x.decode().isspace() for x in new]
        plain, rest = [x for x, b in zip(new, blank) if not b], [x for x, b in zip(new, blank) if b]
        groups = [plain[at : at + 2000] for at in range(0, len(plain), 2000)]
        ids, sizes = [self.flat], []
        for group in groups:
            lines = b"\n".join(group).decode()
            found = self.quick.encode_to_numpy(lines).astype(np.int32) if self.quick else np.array(self.whole.encode(lines, add_special_tokens=False).ids, np.int32)
            line = np.flatnonzero(found == self.line)
            if len(line) != len(group) - 1:
                raise RuntimeError("pre-tokens aren't apart")
            ids.append(np.delete(found, line))
            sizes += (np.diff(line, prepend=-1, append=len(found)) - 1).tolist()
        for got in self.whole.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False):
            ids.append(np.array(got.ids, np.int32))
            sizes.append(len(got.ids))
        for x in plain + rest:
            self.known[x] = len(self.known)
        self.flat = np.concatenate(ids)
        self.at = np.append(self.at, self.at[-1] + np.cumsum(np.array(sizes, np.int64)))

    def _gather(self, tokens: list[bytes], stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a stream of numbers of distinct tokens, and how many each has."""
        new = [x for x in tokens if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = tokens
        if new:
            self._learn(new)
        number = np.fromiter((self.known[x] for x in tokens), np.int64, len(tokens))[stream]
        sizes = self.at[number + 1] - self.at[number]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    @staticmethod
    def _points(texts: list[str], but: set[int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts but some as one, their lengths, code points and the classes of these."""
        text = "".join(x for i, x in enumerate(texts) if i not in but) if but else "".join(texts)
        n = np.fromiter((0 if i in but else len(x) for i, x in enumerate(texts)), np.int64, len(texts))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return text, n, points, kinds(points)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and where each text's begin (one more at the end)."""
        whole = {i for i, x in enumerate(texts) if not self.split or any(s in x for s in self.special)}
        text, n, points, kind = self._points(texts, whole)
        odd = np.flatnonzero(kind == _OTHER)
        if len(odd):
            whole |= set(np.searchsorted(np.cumsum(n), odd, "right").tolist())
            text, n, points, kind = self._points(texts, whole)
        given = dict(zip(whole, (np.array(x.ids, np.int32) for x in self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))))
        sizes = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.int32)
        if len(points):
            stops = np.cumsum(n)
            begins = pre_tokens(points, kind, (stops - n)[n > 0])
            data = text.encode()
            if len(data) == len(points):
                offsets = np.append(begins, len(data))
            else:
                width = np.ones(len(points), np.uint8)
                for more in (0x80, 0x800):
                    width += points >= more
                offsets = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(begins, len(points))]
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            ids, each = self._gather(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy())
            sizes += np.bincount(np.searchsorted(stops, begins, "right"), each, len(texts)).astype(np.int64)
        if given:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in given.items():
                parts[i], sizes[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, np.append(0, np.cumsum(sizes))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_erf = np.vectorize(erf, otypes=[float])


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of places (whole numbers below 2**bits): bits are taken from the top, undoing each cube's turn and reflection."""
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def keys(ids: np.ndarray, at: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each document. Sums are of whole numbers, so a document's key depends on its ids alone."""
    sizes = np.diff(at)
    pairs, n = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes) | ids, return_counts=True)
    document, feature = pairs >> 32, pairs & 0xFFFFFFFF
    weight = np.rint(64 * np.sqrt(n)).astype(np.int64)
    signs = mix(feature.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(document, np.arange(len(sizes) + 1))
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[first])
    norm = np.sqrt(np.maximum(total(weight * weight), 1).astype(float))
    sums = np.stack([total(np.where(signs >> np.uint64(k) & np.uint64(1), weight, -weight)) for k in range(dimensions)], 1)
    unit = (1 + _erf(sums / norm[:, None] / np.sqrt(2))) / 2
    return hilbert(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def encoded(docs: DataFrame, tokenizer: str, end: int, text: str) -> DataFrame:
    """given (the other columns), row (a number of its own), ids (binary, of two or four bytes each), n, key and digest, of each document with its closing id."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    rows = docs.select(F.struct(*[F.col(c) for c in names] or [F.lit(0).alias("none")]).alias("given"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("ids binary, n long, key long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        small = max(own.vocabulary, end + 1) <= 1 << 16
        for batch in batches:
            for start, count in slices(batch.column(2), SLICE):
                given, row, texts = batch.slice(start, count).columns
                ids, at = own.encode(texts.to_pylist())
                at = at + np.arange(len(at))
                ids = np.insert(ids, at[1:] - np.arange(1, len(at)), end)
                data = ids.astype("<u2" if small else "<u4")
                offsets = (at * data.itemsize).astype(np.int64)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([given, row, coded, pa.array(np.diff(at)), pa.array(keys(ids, at))], names=["given", "row", "ids", "n", "key"])

    return rows.mapInArrow(run, schema).withColumn("digest", F.xxhash64("ids"))


def placed(rows: DataFrame) -> DataFrame:
    """row and place: how many ids lie before each document on the curve. rows: row, n, and what to sort by."""
    order = [F.col("key"), F.col("digest"), F.col("id").asc_nulls_last(), F.col("row")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn"))
    parts = kept(parts)
    sums = parts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a range
    before = np.cumsum([0, *[r["n"] for r in sums]]).tolist()
    shift = rows.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sums, before)], "part int, shift long")
    own = F.sum("n").over(Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("row", "part", F.coalesce(own, F.lit(0)).alias("own")).join(shift, "part").select("row", (F.col("own") + F.col("shift")).alias("place"))


def layout(place: int, n: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """start, length, sequence_id and offset of the pieces of n ids from a place on the line of total ids."""
    full = total // length
    at, stop = place, place + n
    while at < stop:
        if at < full * length:
            sequence, offset = divmod(at, length)
            size = length
        else:  # the rest, in powers of two from the largest
            left, sequence, offset = total - full * length, full, at - full * length
            size = 1 << left.bit_length() - 1
            while offset >= size:
                offset, left, sequence = offset - size, left - size, sequence + 1
                size = 1 << left.bit_length() - 1
        take = min(stop - at, size - offset)
        yield at - place, take, sequence, offset
        at += take


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """The pieces of documents, without text: start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset, and
    with ids the ids themselves. A sequence is its pieces in order of offset. tokenizer: a file that every executor has at this path."""
    rows = kept(encoded(docs, tokenizer, end, text))
    names = [c for c in rows.schema["given"].dataType.names if c != "none" or "none" in docs.columns]
    sizes = rows.select("row", "n", "key", "digest", F.col("given")[doc_id].alias("id"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    both = rows.select("given", "row", "ids", "n").join(placed(sizes), "row").select("given", "ids", "n", "place")
    fields = T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if ids else "")).fields
    schema = T.StructType([both.schema["given"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, which, parts = [], [], []
            for i, (raw, n, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                own = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, size, sequence, offset in layout(place, n, total, length):
                    part = own[start : start + size]
                    made.append((start, size, zlib.crc32(part), n, sequence, offset))
                    which.append(i)
                    if ids:
                        parts.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(which, pa.int64())), *map(pa.array, np.array(made, np.int64).reshape(-1, 6).T)]
            if ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    made = both.mapInArrow(run, schema)
    return made.select(*[F.col("given")[c].alias(c) for c in names], *[f.name for f in fields])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
