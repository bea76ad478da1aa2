"""Packing, the filter interaction audit and the source divergence audit against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblathe.llm import filter_audit, packing, source_divergence

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string"


# Packing


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check_packed(rows, docs, length=2048):
    """All that the contract asks of pieces: rows of pack's digest columns against documents (id, text), ids unique."""
    lib = _library()
    want = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for d, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            ids = np.array(want[d][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(want[d]), zlib.crc32(ids.tobytes())) and r["length"] > 0
            if r.asDict().get("ids") is not None:
                assert r["ids"] == ids.tolist()
            at += r["length"]
        assert at == len(want[d])
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0 and sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(packing.query(spark, sf_dir).collect(), docs)


@pytest.mark.parametrize("length", [1, 7, 64])
def test_packing_of_short_sequences(spark, length):
    r = random.Random(length)
    docs = [(i, None if i == 3 else " ".join(r.choice(["a", "Bc", "déf", "中文", "x's", "<|endoftext|>", "\n"]) for _ in range(r.randint(0, 30)))) for i in range(40)]
    docs += [(100 + i, "the same text here") for i in range(30)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), P.path("byte_bpe_50k.json"), length=length).collect()
    check_packed(rows, docs, length)


def test_packing_of_odd_rows(spark):
    """Null ids and texts, repeated rows, a long text, columns named like helpers or results, no rows; reruns and other partitions agree."""
    rows = [(1, "Some text", "en", "a"), (1, "Some text", "en", "a"), (2, None, None, None), (None, "Some text", "en", "b"), (None, "", "", None), (5, "word " * 30000, "en", "a"), (6, "x" * 100000, "en", "é")]
    df = spark.createDataFrame(rows, DOC)
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pack = lambda d: packing.pack(d, P.path("byte_bpe_50k.json"))
    got = pack(df.repartition(3)).select(own).collect()
    more = pack(df.repartition(2).withColumns({c: F.lit("q") for c in ("row", "given", "ids", "n", "key", "digest", "place", "part", "id", "start", "none", "t", "turn", "own", "shift")}))
    assert sorted(map(repr, got)) == sorted(map(repr, more.select(own).collect()))
    assert {r[0] for r in more.select("key").distinct().collect()} == {"q"} and sum(r["start"] == 0 for r in got) == len(rows)
    assert {r["doc_tokens"] for r in got if r["doc_id"] == 2} == {1}
    assert pack(df.limit(0)).collect() == []


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of a few topics, shuffled: most documents of a sequence are of one topic, far more than by chance."""
    r = random.Random(4)
    words = [["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for _ in range(8)]
    docs = [(i, " ".join(r.choice(words[i % 8]) for _ in range(100))) for i in range(400)]
    r.shuffle(docs)
    sequences = check_packed(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), P.path("byte_bpe_50k.json"), ids=False).collect(), docs)
    most = [max(Counter(x["doc_id"] % 8 for x in found).values()) / len(found) for found in sequences.values() if len(found) > 3]
    assert sum(most) / len(most) > 0.5  # about 0.35 by chance


def test_hilbert_curve():
    for n, bits in ((2, 5), (3, 3), (4, 2)):
        grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n)], 1)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)) == {1}  # one step at a time


def test_packing_encoder_is_the_library():
    r = random.Random(1)
    lib, own = _library(), packing.Encoder(P.path("byte_bpe_50k.json"))
    alphabet = ["a", "'", "s", "t", "re", "ll", "ve", "m", "d", " ", "  ", "\n", "\t", "1", "é", "\xa0", "\x85", "²", "-", "_", "!", "…", "ß", "я", "Ω", "中", "\x1c", "\x1f", " ", "\r\n", "𝔸", "<|endoftext|>", " 's", "S", "́", "ǅ"]
    texts = ["".join(r.choice(alphabet[: r.choice([9, 12, 16, 24, len(alphabet)])]) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += [f"a{c}b 1{c} {c}{c} x{c}" for c in map(chr, [*range(0x700), *range(0x1FF0, 0x2210)])]
    for at in range(0, len(texts), 300):
        ids, starts = own.encode(texts[at : at + 300])
        want = lib.encode_batch(texts[at : at + 300], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [x.ids for x in want]


# Filter interaction audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    """Applies the filters one after another, to every document, in every order."""
    out = {}
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for d, t, p in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)}
        parts[p or ""].append((d, fails))
    for p, found in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = found
            for k, f in enumerate(order, 1):
                lost = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(lost)
                out[p, "".join(order), k] = [
                    len(left), len(lost), sum(x[1][f] for x in found) - len(lost), sum(x[1][f] and sum(x[1].values()) == 1 for x in found),
                    sum(x[0] in good for x in lost), sum(x[0] in toxic for x in lost),
                ]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[p, "".join(order), k].append(shapley[f])
    return out


def _audit(docs, labels):
    rows = filter_audit.audit(filter_audit.cells(docs, labels), list("ABCDE")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in rows}
    assert len(got) == len(rows)
    return got


def test_filter_audit_by_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "Cd", "E#", "%"] + [f"w{k}" for k in range(r.choice([1, 400]))]) for _ in range(r.choice([5, 199, 200, 260]))) for _ in range(25)] + [None, "", " \n", "ÄÖ" * 3]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "de", None, "", "fr"])) for _ in range(150)]
    docs += docs[:10]
    labels = [(i % 70, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(90)] + [(None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    assert _audit(df, told) == want
    clash = {c: F.lit("x") for c in ("t", "s", "part", "mask", "digest", "n", "n_words", "first", "good", "cells", "kept")}
    assert _audit(df.withColumns(clash), told.withColumns(clash | {"lang": F.lit("x"), "text": F.lit("y")})) == want
    assert _audit(df.limit(0), told) == {} and _audit(df, told.limit(0)) == brute_audit(docs, [])


@pytest.mark.parametrize("n", range(1, 7))
def test_walk_visits_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in filter_audit.walk(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_shapley_shares_add_up(spark, sf_dir):
    """In each part, an order's shares are all that is ever removed, summed over the orders."""
    rows = filter_audit.query(spark, sf_dir)
    found = rows.groupBy("part", "filter_order").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert all(x["s"] == 120 * x["r"] for x in found) and len(found) % 120 == 0


# Source divergence audit


def brute_divergence(docs, least=source_divergence.LEAST, ranks=source_divergence.RANKS):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for t, g, s in docs:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
        counts[g or "", s or ""].update(w)
        df[g or ""].update(set(w))
    out = []
    for lang in df:
        terms = [t for t, n in df[lang].items() if n >= least]
        own = {s: c for (g, s), c in counts.items() if g == lang}
        total = Counter()
        for c in own.values():
            total.update({t: c[t] for t in terms})

        def p(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(terms)) for t in terms}

        ps, q = {s: p(c) for s, c in own.items()}, p(total)
        for s in own:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in terms), o.encode(), o) for o in own if o != s]
            first = [(q[t] - ps[s][t], t.encode(), t) for t in terms if own[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(first)[:ranks])):
                out += [(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def _diverging(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_divergence.divergence(df, **more).collect())


@pytest.mark.parametrize("portion", [source_divergence.PORTION, 3])
def test_divergence_by_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(source_divergence, "PORTION", portion)
    monkeypatch.setattr(source_divergence, "SLICE", 2000)
    r = random.Random(portion)
    terms = ["a", "B", "é", "中文", "don't", "x1y", "É", "ß", "İ", "Z", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]]
    docs = [(r.choice([None, "", "12 34", " ".join(r.choice(terms) for _ in range(r.randint(1, 60)))]), r.choice(["en", "de", None, "", "xx"]), r.choice(["s", "t", None, "", "ü", "u"])) for _ in range(700)]
    docs += [("q " * 40, "hot", "s")] * 60 + [("rare", "one", "s"), ("", "one", "t"), (None, "lone", "s")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    want = brute_divergence(docs)
    assert _diverging(df) == want and len({w[0] for w in want}) > 4
    clash = {c: F.lit("x") for c in ("term", "count", "df", "n", "v", "no", "parts", "portion", "item", "value", "rank", "total", "doc_id")}
    assert _diverging(df.withColumns(clash)) == want
    assert _diverging(df, least=5, ranks=3) == brute_divergence(docs, 5, 3)
    assert _diverging(df.limit(0)) == []


def test_probabilities_are_exact(spark):
    r = random.Random(2)
    pairs = [(c, c * 2 + r.randrange(1, 10**k)) for k in range(1, 16) for c in (0, 1, r.randrange(10**k) // 3)]
    want = [1 + 10**9 * (c + 5) // t for c, t in pairs]
    got = [source_divergence.probabilities(np.array([c]), np.array([t]))[0] for c, t in pairs]
    p = source_divergence.probability(F.col("c"), F.col("t"), F.lit(0))
    assert got == want == [x["p"] for x in spark.createDataFrame(pairs, "c long, t long").coalesce(1).select(p.alias("p")).collect()]
