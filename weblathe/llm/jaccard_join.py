"""N-gram Jaccard join under several global token orders, and the components of its links.

Two texts link when 100 * |intersection| >= 75 * |union| of their shingle sets. A set of n shingles can only link if at
least need = ceil(0.75 n) of them occur in another text. In a global order that puts shingles of one text first, the
prefix of a set that has fewer is all its own: it has no candidate. So

1. every task sends its distinct shingles, 4 bytes each, dealt by their upper bits; one that several texts of the task
   share is sent once. Where they meet, shingles that came more than once count for their texts, and texts with fewer
   than need such shingles have no link. This moves each shingle once and joins nothing.
2. The sets of the remaining texts are collapsed to one per distinct set (copies need no pairs), their shingles are
   counted exactly, and those of a single set are dropped.
3. With r shared shingles left, a prefix of r - need + 1 has to meet the other set's prefix, under any order that both
   use. Candidates come from the first order (rarest first), by its prefix, lengths and positions; they must also
   meet in the prefixes of the second (rarest first, other ties) and third (by hash) order before they are verified.
4. Links are first sought to one leader a prefix shingle, under two orders and then anew among the components that
   still meet, and merged into components. What is left are pairs between different components only. The join that finds them refuses, in its own condition, pairs whose 512
   parities (each shingle flips one) show that they differ in too many shingles; every other pair is verified. Sets of a shingle's largest component are
   compared with the shingle's other sets only. So no link between components is lost, and no group of copies is expanded into its pairs.

Null and empty texts have no shingles and link with nothing: their component is their own doc_id. The component of a
group of rows is its smallest doc_id that isn't null, so a null id takes part with the others; a component of null ids
only has a null id. Repeated rows share a component. An empty table gives no rows. Columns other than doc_id and text
aren't returned by `components_of`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.llm.common import kept, small_batches, table
from weblathe.llm.components import components
from weblathe.llm.shingles import mix, shingle_sets
from weblathe.llm.url_filter import MAX_BYTES, Level, level

PERCENT = 75
#: How often links are sought to one leader a shingle before all pairs of different components are.
ROUNDS = 2
#: Parities kept of each set.
BITS = 512
#: Digests of 16 bytes that are broadcast.
BROADCAST = 500_000
#: Shingles that meet in one task, about.
CHUNK = 1_000_000
#: Shingles that a task holds before it sends them.
FLUSH = 600_000
#: Characters of text that are fingerprinted at a time.
SLICE = 1_000_000


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    at = 0
    for n in np.unique(size, return_counts=True)[1].tolist():
        yield at, n
        at += n


def needed(n, percent: int = PERCENT):
    return -(-percent * n // 100)


def fingerprints(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set, equal for equal sets."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt))))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    a, b = (mix(s[at[1:]] - s[at[:-1]] + np.diff(at).astype(np.uint64)) for s in sums)
    return a.view(np.int64), b.view(np.int64)


def parities(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS parities of each set, as 64-bit words: every shingle flips one, so sets differ in at least as many shingles as bits."""
    place = mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)
    bit = np.left_shift(np.uint64(1), place & np.uint64(63))
    word = (place >> np.uint64(6)).astype(np.int64)
    out = np.zeros((len(at) - 1, BITS // 64), np.uint64)
    some = np.flatnonzero(np.diff(at))
    for k in range(BITS // 64):
        if len(some):
            out[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at[some])
    return out.view(np.int64)


# Step 1: which texts can have a link


def _sent(sets: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """The sets of a flush: a row for each chunk that has any of their shingles, and one (chunk -1: n, r, keys) of the sets themselves."""
    sizes = np.concatenate([np.diff(at) for _, at in sets])
    keys = np.concatenate([fingerprints(v, at)[0] for v, at in sets])
    values = np.concatenate([v for v, _ in sets])
    sets.clear()
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    del order
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(values)))
    r = np.bincount(owner[np.repeat(runs > 1, runs)], minlength=len(sizes)).astype(np.uint32)
    kind = np.uint16 if len(sizes) < 0xFFFF else np.uint32
    values = values[first]
    owner = np.where(runs == 1, owner[first], np.iinfo(kind).max).astype(kind)
    chunk = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cuts = np.append(np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, np.int64), len(chunk))
    low = ((values << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    own = np.append(keys, len(keys)).view(np.uint64)  # the same if the task is run again
    name = int(mix(own + np.arange(len(own), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
    n = len(cuts)

    def binary(at: np.ndarray, data: np.ndarray, last: bytes) -> pa.Array:
        ends = np.append(at * data.itemsize, len(data) * data.itemsize + len(last)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes() + last)])

    chunks = np.append(chunk[cuts[:-1]], -1).astype(np.int32)
    keyed = pa.array([b""] * (n - 1) + [keys.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks), pa.array(np.full(n, name)), binary(cuts, low, sizes.astype(np.uint32).tobytes()), binary(cuts, owner, r.tobytes()), keyed, pa.array(np.full(n, kind is np.uint32))],
        names=["chunk", "flush", "shingles", "owners", "keys", "wide"],
    )


def _send(bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            texts = batch.column(0)
            for at, n in slices(texts):
                sets.append(shingle_sets(texts.slice(at, n)))
                held += len(sets[-1][0])
                if held >= most:
                    yield _sent(sets, bits)
                    held = 0
        if sets:
            yield _sent(sets, bits)

    return run


def _met(t: pa.Table) -> pa.Table:
    """Of a chunk: a row for each flush, of how many of the chunk's shingles its sets share with another. A flush's own row is passed on."""
    cols = [t[c].to_pylist() for c in ("chunk", "flush", "shingles", "owners", "keys", "wide")]
    if cols[0] and cols[0][0] < 0:
        return pa.table({"flush": t["flush"], "owners": t["shingles"], "counts": t["owners"], "keys": t["keys"]})
    kinds = [np.uint32 if w else np.uint16 for w in cols[5]]
    values = np.concatenate([np.frombuffer(v, np.uint32) for v in cols[2]])
    owners = [np.frombuffer(o, k) for o, k in zip(cols[3], kinds)]
    none = np.concatenate([o == np.iinfo(o.dtype).max for o in owners])
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    shared &= ~none
    ends, out = np.cumsum([len(o) for o in owners]), {"flush": [], "owners": [], "counts": [], "keys": []}
    for flush, o, end in zip(cols[1], owners, ends.tolist()):
        found, n = np.unique(o[shared[end - len(o) : end]], return_counts=True)
        if len(found):
            out["flush"].append(flush), out["owners"].append(found.astype(np.uint32).tobytes()), out["counts"].append(n.astype(np.uint32).tobytes()), out["keys"].append(b"")
    return pa.table({c: pa.array(x, pa.int64() if c == "flush" else pa.binary()) for c, x in out.items()})


def _summed(t: pa.Table) -> pa.Table:
    """Of a flush: each set's fingerprint, size, and shingles shared with another set. Equal flushes come as several own rows."""
    key, n, r, more = [], [], [], []
    for o, c, k in zip(*(t[x].to_pylist() for x in ("owners", "counts", "keys"))):
        if k:
            key.append(np.frombuffer(k, np.int64)), n.append(np.frombuffer(o, np.uint32)), r.append(np.frombuffer(c, np.uint32))
        else:
            more.append((np.frombuffer(o, np.uint32), np.frombuffer(c, np.uint32)))
    if not key:
        return pa.table({c: pa.array([], pa.int64()) for c in ("key", "n", "r")})
    total = r[0].astype(np.int64)
    for o, c in more:
        total[o] += c
    return pa.table({"key": pa.array(key[0]), "n": pa.array(n[0].astype(np.int64)), "r": pa.array(total)})


def linkable(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK, flush: int = FLUSH) -> DataFrame:
    """Fingerprints (a) of the sets that have enough shingles in other texts; a superset, by a few, of what has a link.

    Chunks hold about as many shingles each at any size of the input; a flush sends a row to each chunk that it has shingles of, so
    rows are never more than shingles.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(0, math.ceil(math.log2(max(1, size / 6 / chunk)))))
    sent = docs.select("text").mapInArrow(_send(bits, flush), "chunk int, flush long, shingles binary, owners binary, keys binary, wide boolean")
    spread = F.when(F.col("chunk") < 0, F.col("flush")).otherwise(0)
    met = sent.groupBy("chunk", spread).applyInArrow(_met, "flush long, owners binary, counts binary, keys binary")
    summed = met.groupBy("flush").applyInArrow(_summed, "key long, n long, r long")
    total = summed.groupBy("key").agg(F.max("n").alias("n"), F.sum("r").alias("r"))
    return total.filter((F.col("n") > 0) & (F.col("r") * 100 >= F.col("n") * percent)).select(F.col("key").alias("a"))


# Step 2: sets, and what they share


def with_sets(docs: DataFrame, some: Level | None) -> DataFrame:
    """doc_id, key, n, a, b, and the shingles of sets whose a passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in slices(batch.column(2)):
                part = batch.slice(start, count)
                values, at = shingle_sets(part.column(2))
                a, b = fingerprints(values, at)
                n = np.diff(at)
                keep = n > 0
                if some is not None:
                    keep &= some.has(a.view(np.uint64), a.view(np.uint64))
                shown = np.repeat(keep, n)
                offsets = np.concatenate(([0], np.cumsum(np.where(keep, n, 0)))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~keep, False)), pa.array(values[shown].view(np.int64)))
                bits = parities(values, at).reshape(-1)[np.repeat(keep, BITS // 64)]
                ends = np.concatenate(([0], np.cumsum(np.where(keep, BITS // 64, 0)))).astype(np.int32)
                flags = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~keep, False)), pa.array(bits))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n), pa.array(a), pa.array(b), sets, flags], names=["doc_id", "key", "n", "a", "b", "shingles", "bits"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n long, a long, b long, shingles array<long>, bits array<long>")


def named(sets: DataFrame) -> DataFrame:
    """sets with id, one for each distinct set: its first fingerprint, or one of both where several sets have the same first."""
    several = kept(sets.filter("n > 0").groupBy("a").agg(F.min("b").alias("b1"), F.max("b").alias("b2")).filter("b1 <> b2").select("a"))
    if several.isEmpty():
        return sets.withColumn("id", F.when(F.col("n") > 0, F.col("a")))
    both = sets.join(several.withColumn("several", F.lit(True)), "a", "left")
    return both.withColumn("id", F.when(F.col("n") > 0, F.when(F.col("several"), F.xxhash64("a", "b")).otherwise(F.col("a")))).drop("several")


def shared_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n, need, r and three orders of the r shingles that other sets have too: o1 whole, o2 and o3 prefixes."""
    one = sets.filter("shingles IS NOT NULL").groupBy("id").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.min(F.xxhash64("a", "b")).alias("u"), F.max(F.xxhash64("a", "b")).alias("v"))
    one = kept(one.filter(F.assert_true(F.col("u") == F.col("v"), "two sets have one name").isNull()).select("id", "n", "shingles", "bits"))
    rows = one.select("id", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    lists = rows.join(often, "s").groupBy("id").agg(F.collect_list(F.struct("df", "s")).alias("found"))  # at most a text's shingles
    out = lists.join(one.select("id", "n", "bits"), "id").withColumn("need", need).withColumn("r", F.size("found").cast("long")).filter("r >= need")
    room = (F.col("r") - F.col("need") + 1).cast("int")

    def order(*by) -> Column:
        keyed = F.transform("found", lambda x: F.struct(*[f(x).alias(f"k{i}") for i, f in enumerate(by)], x["s"].alias("s")))
        return F.transform(F.sort_array(keyed), lambda x: x["s"])

    o1 = order(lambda x: x["df"])
    o2 = F.slice(order(lambda x: x["df"], lambda x: F.xxhash64(F.lit(17), x["s"])), 1, room)
    o3 = F.slice(order(lambda x: F.xxhash64(F.lit(29), x["s"])), 1, room)
    return kept(out.select("id", "n", "need", "r", "bits", o1.alias("o1"), o2.alias("o2"), o3.alias("o3")))


# Steps 3 and 4: candidates and links


def _enough(percent: int, n1: str, n2: str) -> Column:
    """The least intersection of sets of these sizes that link."""
    return F.ceil((F.col(n1) + F.col(n2)) * percent / (100 + percent) - 1e-9)


def _near(percent: int) -> Column:
    """False for sets x and y whose parities show that they differ in too many shingles to link."""
    differ = sum((F.bit_count(F.get("x_bits", F.lit(k)).bitwiseXOR(F.get("y_bits", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return differ <= F.col("x_n") + F.col("y_n") - 2 * _enough(percent, "x_n", "y_n")


def prefixes(sets: DataFrame, order: str) -> DataFrame:
    room = (F.col("r") - F.col("need") + 1).cast("int")
    return sets.select("id", "n", "r", "bits", F.posexplode(F.slice(order, 1, room)).alias("pos", "s"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y): those that link. All orders' prefixes must meet before the sets are intersected."""
    side = lambda p: sets.select(*[F.col(c).alias(p + c) for c in ("id", "n", "r", "bits", "o1", "o2", "o3")])
    both = pairs.join(side("x_"), F.col("x") == F.col("x_id")).join(side("y_"), F.col("y") == F.col("y_id"))
    may = _near(percent) & (F.least("x_r", "y_r") >= _enough(percent, "x_n", "y_n")) & F.arrays_overlap("x_o2", "y_o2") & F.arrays_overlap("x_o3", "y_o3")
    inter = F.size(F.array_intersect("x_o1", "y_o1"))
    link = 100 * inter >= percent * (F.col("x_n") + F.col("y_n") - inter)
    return both.filter(F.when(may, link).otherwise(False)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, component (an id) of every set that links with another."""
    pairs = None
    for order, salt in (("o1", 41), ("o3", 43)):
        rows = prefixes(sets, order)
        first = F.struct(F.xxhash64(F.lit(salt), "id"), "id")
        lead = rows.groupBy("s").agg(F.min(first).alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("s", F.col("lead.id").alias("lead"))
        star = rows.join(lead, "s").filter("id <> lead").select(F.least("id", "lead").alias("x"), F.greatest("id", "lead").alias("y"))
        pairs = star if pairs is None else pairs.unionByName(star)
    near = kept(verified(kept(pairs.distinct()), sets, percent).distinct())
    merged = kept(components(near))
    enough = _enough(percent, "x_n", "y_n")
    may = (F.col("x_c") != F.col("y_c")) & (F.col("x_id") != F.col("y_id")) & (F.col("x_r") - F.col("x_pos") >= enough) & (F.col("y_r") - F.col("y_pos") >= enough) & _near(percent)
    for salt in range(ROUNDS + 1):
        rows = prefixes(sets, "o1").join(merged, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
        # a shingle's largest component is compared with the others only, so a large group of near copies costs its size and not its square
        held = rows.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k"))
        several = held.groupBy("s").agg(F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("components")).filter("components > 1")
        rows = kept(rows.join(several.select("s", F.col("most.c").alias("most")), "s").withColumn("main", F.col("c") == F.col("most")).drop("most"))
        side = lambda p, r: r.select(F.col("s").alias(p + "s"), *[F.col(k).alias(p + k) for k in ("c", "id", "n", "r", "bits", "pos", "main")])
        if salt < ROUNDS:  # a leader of each shingle's own; what has many links meets one of them
            lead = rows.groupBy("s").agg(F.min(F.xxhash64(F.lit(salt), "s", "id")).alias("least"))
            one, other = rows, rows.join(lead, "s").filter(F.xxhash64(F.lit(salt), "s", "id") == F.col("least"))
            on = may
        else:  # everything that is left
            one, other = rows.filter("NOT main"), rows
            on = may & (F.col("y_main") | (F.col("x_id") < F.col("y_id")))
        # all of the filter is the join's own condition: pairs that it refuses, and pairs within a component, are never made
        found = side("x_", one).join(side("y_", other), (F.col("x_s") == F.col("y_s")) & on)
        found = kept(found.select(F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")).distinct())
        more = kept(verified(found, sets, percent).distinct())
        if more.isEmpty() and salt < ROUNDS:
            continue
        near = near.unionByName(more)
        merged = kept(components(near))
    return merged


def all_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: all pairs of different sets that link, a < b; also those within a component."""
    rows = kept(prefixes(sets, "o1"))
    side = lambda p: rows.select(F.col("s").alias(p + "s"), *[F.col(k).alias(p + k) for k in ("id", "n", "r", "bits", "pos")])
    enough = _enough(percent, "x_n", "y_n")
    may = (F.col("x_id") < F.col("y_id")) & (F.col("x_r") - F.col("x_pos") >= enough) & (F.col("y_r") - F.col("y_pos") >= enough) & _near(percent)
    pairs = side("x_").join(side("y_"), (F.col("x_s") == F.col("y_s")) & may).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    return verified(kept(pairs.distinct()), sets, percent)


def links_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b) for all pairs of different sets that link, and doc_id, a: the set of each of docs with words.

    Equal sets are one, so documents of one a link as well.
    """
    every = _with_sets_of(docs, doc_id, text, percent)
    return kept(all_links(shared_sets(every, percent), percent)), every.filter("n > 0").select("doc_id", F.col("id").alias("a"))


def _with_sets_of(docs: DataFrame, doc_id: str, text: str, percent: int, keyed: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))) if keyed else F.lit(None).cast("binary")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    able = kept(linkable(docs, percent))
    n = able.count()
    some = level(able.select("a", F.col("a").alias("b")), n, max(1e-4, 2.0 ** (-MAX_BYTES * 5.5 / max(1, n))), 1) if n else Level(np.zeros(8, np.uint8), 1)
    return named(kept(with_sets(docs, some)))


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int, keyed: bool = False) -> DataFrame:
    """doc_id, key, n, the set's component c (null without shingles), and the smallest doc_id of it; a row for each of docs."""
    every = _with_sets_of(docs, doc_id, text, percent, keyed)
    found = links(shared_sets(every, percent), percent)
    sets = every.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    sets = kept(sets.join(found, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).select("id", "least", "c"))
    low = sets.groupBy("c").agg(F.min("least").alias("least"))
    known = sets.select("id", "c").join(low, "c")
    return every.select("doc_id", "key", "n", "id").join(known, "id", "left").select("doc_id", "key", "n", "c", "least")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each of docs."""
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return _grouped(docs, doc_id, text, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when each component keeps one: that with the smallest doc_id, null last, then of the first text by MD5.

    Rows are told apart by their texts and not by their ids, so repeated and null ids are no trouble; rows of one text stay or go together.
    Texts without words stay.
    """
    rows = kept(_grouped(docs, doc_id, text, percent, True).filter("n > 0").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("row"), "c"))
    first = rows.groupBy("c").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    name = "gone" + "_" * max(map(len, docs.columns), default=0)  # longer than any of docs' own
    gone = kept(rows.join(first, "c").filter(F.col("row.key") != F.col("first.key")).select(F.col("row.key").alias(name)).distinct())
    own = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, own == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
