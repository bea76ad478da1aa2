"""Each operator against brute force, its library or SQL, and on odd rows."""

import html
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weblathe.llm import components, exact_dedup, jaccard_join, license_scan, mixing, pieces, quality_model, quality_rules, queries, shingles, site_style, token_counts, url_filter

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
ODD = [
    (1, "Some text of a few words", "en", "a", 1, "x", "y"), (1, "Some text of a few words", "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (None, "Some  text of a few words", "en", "b", 1, "x", "y"),
    (None, "", "en", None, 0, None, None), (5, "w " * 30000, "en", "a", 1, None, None), (6, "x" * 100000, "en", "é", 1, None, None), (7, " \t\n", "en", "b", 1, None, None),
]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, same, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


#: Columns named like helpers that operators use inside.
HELPERS = "keys a b given t html host_ page digest rank id stays tied best tie turn own_rank text_digest task lost soft whole node no cut cuts key hash scale dual size_ each more turn x y places matches_ of_words of_lines the_text row at n c least words classes part wanted gone gone_".split()
PAGES = [
    (1, "http://a.example.com/en/x", "<p>One</p><nav>x</nav>"), (1, "http://a.example.com/en/x", "<p>One</p><nav>x</nav>"), (2, None, None), (None, "http://example.net/es/", ""), (3, "no url", "<"), (4, "http://" + "l." * 3000 + "com/" + "p" * 5000, "<div>" * 500 + "w " * 30000),
]


def _operators(spark):
    bpe, model = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
    fitted = quality_model.Model(0.2)
    return {
        "dedup": (exact_dedup.dedup, exact_dedup.RESULTS), "rules": (quality_rules.judge, quality_rules.RESULTS), "licenses": (license_scan.scan, license_scan.RESULTS), "mix": (mixing.mix, mixing.RESULTS),
        "tokens": (lambda d: token_counts.count_tokens(d, bpe), token_counts.RESULTS), "pieces": (lambda d: pieces.encode(d, model), pieces.RESULTS), "model": (lambda d: quality_model.score(d, fitted), ("score", "predicted")),
        "components": (jaccard_join.components_of, ("doc_id", "n_shingles", "component_id")), "representatives": (jaccard_join.representatives, ()),
        "urls": (lambda d: url_filter.judge(d, url_filter.RULES), ("host", "path", "rule", "verdict")), "style": (site_style.extract, ("text", "n_chars")),
    }


@pytest.mark.parametrize("name", ["dedup", "rules", "licenses", "mix", "tokens", "pieces", "model", "components", "representatives", "urls", "style"])
def test_odd_rows(spark, name):
    """Nulls, empty and long texts, repeated rows, columns named like helpers or results, and empty tables: the same results, and other columns unchanged."""
    f, results = _operators(spark)[name]
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string") if name in ("urls", "style") else spark.createDataFrame([r[:5] for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.repartition(3)
    taken = {c.lower() for c in [*df.columns, *results]}
    extra = {h: F.lit(h) for h in HELPERS if h not in taken}
    clash = {c: F.lit(None).cast("binary") for c in results if c not in df.columns}
    plain, more = f(df), f(df.withColumns(extra | clash))
    own = plain.columns
    rows = lambda d: sorted(map(repr, d.select(own).collect()))
    assert rows(plain) == rows(more) and len(rows(plain)) == (len(PAGES) if "page_id" in df.columns else len(ODD) if name != "representatives" else len(rows(plain)))
    if name != "components":
        assert more.select([h for h in extra]).distinct().collect() == [tuple(extra)]
    assert f(df.limit(0)).collect() == []


def test_dedup_of_odd_rows(odd):
    rows = exact_dedup.dedup(odd.drop("kept")).collect()
    assert sum(r["kept"] for r in rows) == 4  # the sentence, the two long texts, nothing
    assert {r["keep_id"] for r in rows if r["text"] and r["text"].startswith("Some")} == {None}  # the longest has no id
    assert {(r["group_size"], r["kept"]) for r in rows if r["doc_id"] == 7} == {(3, True)}


def test_repeated_words(spark):
    def brute(text):
        w = text.split()
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})

    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in range(60)] + ["a " * 40, "a b c d e x a b c d e", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x["doc_id"]: x["n_repeat_words"] for x in quality_rules.judge(df).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_stop_words_of_listed_languages_only(spark):
    """Texts in upper case and in languages without stop words here aren't rejected for having none."""
    long = lambda f: " ".join(f"{f}{chr(ord(f) + i % 20)}{chr(ord(f) + i // 20)}x"[: 3 if f > "z" else 4] for i in range(80))
    latin = long("a")
    rows = [(1, long("б"), None), (2, long("α"), "el"), (3, "THE " + latin.upper(), "en"), (4, latin, "fi"), (5, latin, "en"), (6, latin, None), (7, "12 34 " * 40, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}


def test_cascade_is_exact(spark):
    listed = [(f"h{i}.example.com/", "block" if i % 3 else "allow") for i in range(0, 400, 7)]
    urls = [(i, f"http://a.h{i}.example.com/x") for i in range(400)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed).collect()}
    want = dict(listed)
    for i, _ in urls:
        rule = f"h{i}.example.com/"
        assert got[i] == ((rule, want[rule]) if rule in want else (None, "allow"))


def test_cascade_or_join(spark):
    """Rules too many for a level are looked up by a join, with the same results."""
    listed = [(f"h{i}.example.com/", "block" if i % 3 else "allow") for i in range(0, 90, 7)] + [("example.com/q", "block"), ("", "allow")]
    pages = spark.createDataFrame([(i % 60, f"http://a.h{i % 50}.example.com/{'qx'[i % 2]}") for i in range(200)] + [(1, None)], "page_id long, url string")
    got = [sorted(map(repr, url_filter.judge(pages, listed, max_bytes=n).collect())) for n in (url_filter.MAX_BYTES, 1)]
    assert got[0] == got[1] and len(got[0]) == 201
    assert {r["rule"] for r in url_filter.judge(pages, []).collect()} == {None}


def test_odd_urls(spark):
    rows = [(1, "http://WWW.example.com/en/x?y"), (2, None), (3, "example.com/en/"), (4, "https://example.com"), (5, "http://a.notexample.com/en/"), (6, "http://example.net/es/#"), (6, "http://example.net/es/#")]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.RULES).orderBy("page_id").collect()]
    assert got == [(1, "www.example.com/en/", "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "com/", "allow"), (6, "net/es/", "block"), (6, "net/es/", "block")]


def test_site_style(spark, sf_dir):
    def want(h):
        a = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", a))).split())

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in site_style.query(spark, sf_dir).collect()}
    assert got == {r["page_id"]: want(r["html"]) for r in pages.collect()}


def test_style_tree_drops_what_a_site_repeats(spark):
    """A block without a telling name that all pages share goes; the blocks that differ stay."""
    rows = [(i, f"http://h/{i}", f"<body><div class=q>Call us now</div><div class=r><p>Text number {i}<p>More of {i * 7}</div><div id=comments>so {i}</div></body>") for i in range(12)]
    rows += [(90, None, None), (91, "http://h/91", ""), (92, "http://k/1", "<p>a<p>b &lt; c<ul><li>d<li>e</ul>")]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 More of 21" and got[90] == got[91] == "" and got[92] == "a b < c d e"


def test_formulas_stay():
    assert [b[3] for b in site_style.parsed("<article><p>Let <math><mi>x</mi></math> be<p>so</article>")[3]] == ["Let x be", "so"]


def test_pages_of_unclosed_tags(spark):
    """Time and branches grow with the page, not with its square; all text stays."""
    began = time.time()
    _, _, above, blocks = site_style.parsed("".join(f"<div>x{i}" for i in range(20_000)))
    assert time.time() - began < 2 and max(map(len, above.values())) <= site_style.DEEPEST + 1
    assert [b[3] for b in blocks] == [f"x{i}" for i in range(20_000)]
    rows = [(i, f"http://h/{i}", f"<p>{i}" + "".join(f"<div>x{k}" for k in range(3000))) for i in range(3)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {" ".join([str(i), *(f"x{k}" for k in range(3000))]) for i in range(3)}


def test_shared_lines_and_branches_go(spark):
    """Without marked articles and telling names: a line among paragraphs that pages share goes, as does a branch of shared blocks; variety in what is around doesn't matter."""
    page = lambda i: f"<div class=x><p>Start {i}</p>{''.join(f'<p>Line {i} {k}</p>' for k in range(i % 4))}<p>Shared closing line</p></div><div class=q><div><p>Call us</p></div><ul><li>One<li>Two</ul></div>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)] + [(50, "http://small/", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    want = {i: " ".join([f"Start {i}", *(f"Line {i} {k}" for k in range(i % 4))]) for i in range(12)}
    assert got == want | {50: "Start 1 Line 1 0 Shared closing line Call us One Two"}
    broadcast, site_style.BROADCAST = site_style.BROADCAST, 0
    try:
        assert got == {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    finally:
        site_style.BROADCAST = broadcast


def test_copies_of_a_page_arent_template(spark):
    """12 equal pages and one different page of a host keep their text, with and without a marked article."""
    page = lambda tag, i: f"<body><{tag}><h1>Title {i}</h1><p>First of {i}<p>Second of {i}</{tag}></body>"
    rows = [(100 * k + i, f"http://{tag}/p?utm_source={i}", page(tag, min(i, 1))) for k, tag in enumerate(("article", "div")) for i in range(13)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: "Title {0} First of {0} Second of {0}".format(min(n % 100, 1)) for n, _, _ in rows}


def test_a_marked_article_loses_nothing_by_importance(spark):
    """A line that all articles of a host share stays, outside an article it goes."""
    rows = [(100 * k + i, f"http://{tag}/{i}", f"<body><{tag}><h2>Method</h2><p>Text {i}</{tag}></body>") for k, tag in enumerate(("article", "div")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"{'' if n >= 100 else 'Method '}Text {n % 100}" for n, _, _ in rows}


def test_names_in_an_article_only_shift(spark):
    """Sections with ids of headings stay; a telling name in an article needs evidence; outside, whole names decide."""
    ids = ["side-effects", "social-impact", "search-algorithms", "related-work"]
    many = "".join(f'<section id="{x}"><h2 id="{x}">About {x}</h2><p>Text {x}</section>' for x in ids)
    text = " ".join(f"About {x} Text {x}" for x in ids)
    rows = [(1, "http://a/1", f"<article>{many}</article>"), (2, "http://b/2", f'<div>{many}</div><div class="x site-footer">gone</div><div class="related-posts">gone</div>')]
    rows += [(10 + i, f"http://c/{i}", f"<article><p>Text {i}</p><div class=share>Share this</div><div class=notice>Note {i}</div></article>") for i in range(12)]
    rows += [(30, "http://d/1", "<article><p>Text</p><div class=share>Once</div></article>")]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: text, 2: text, 30: "Text Once"} | {10 + i: f"Text {i} Note {i}" for i in range(12)}


def test_comments_and_adverts_in_an_article_go(spark):
    """By whole classes or roles of theirs; not by ids, and not by words that only contain such a name."""
    gone = ["comments", "reader-comments", "comment-list", "x ad-slot", "newsletter", "cookie-notice"]
    stay = ["commentary", "adverse-effects", "address", "made", "responder"]
    made = lambda names, kind: "".join(f"<section {kind}='{x}'><p>In {x}</p></section>" for x in names)
    rows = [(1, "http://a/1", f"<article><p>Text</p>{made(gone, 'class')}{made(stay, 'class')}{made(['comments'], 'id')}</article>")]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["text"]
    assert got == " ".join(["Text", *(f"In {x}" for x in [*stay, "comments"])])


def test_presentation_is_of_child_tags():
    """Nodes with as many blocks but other children differ in shape."""
    tags = [site_style.parsed(f"<div class=a>x<{t}>y</{t}>z</div>")[1] for t in ("b", "i", "b")]
    assert tags[0] == tags[2] != tags[1] and ["", "b"] in tags[0].values()


TEXTS = ["", "  a  b   c", "a\n\nb\tc", " " * 40 + "x", "aaaaaaa", "日本語😀x é", "x<s>y</s><unk>", "<|endoftext|> I'LL don't", "▁▁a", "İΣ ΑΣ. ½²"]


def _random_texts():
    r = random.Random(1)
    return TEXTS + ["".join(r.choice("abcdefghiteonrs \n'’éü日0123.,-_") for _ in range(r.randint(0, 60))) for _ in range(600)] + ["".join(r.choice("et ") for _ in range(50)) for _ in range(300)]


def test_pieces_are_the_library_s():
    import sentencepiece

    own, lib = pieces.Model(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(4)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123+/") for _ in range(20000))
    texts = _random_texts() + ["a" * 5000, "ab" * 70000, letters, "日本語" * 400, "😀" * 300, "the" * 200, " " * 50 + "z", "=_" * 444, "x\n\n\ty\0z"]
    ids, at = own.encode(pa.array(texts))
    assert own.decoded(ids, at).to_pylist() == [t.replace("▁", " ") for t in texts]
    assert own.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0] and own.encode(pa.array([], pa.string()))[1].tolist() == [0]
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == lib.encode(texts)
    assert [own.decode(x) for x in got] == lib.decode(got)
    assert [own.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_token_counts_are_the_library_s():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, lib = token_counts.Counter(path), Tokenizer.from_file(path)
    texts = _random_texts()
    assert own.counts(texts).tolist() == [len(lib.encode(t, add_special_tokens=False)) for t in texts]


def test_license_places(spark):
    rows = [(1, "cc by nc cc-by-NC  cc by ncx"), (2, "under the MIT. License\nunder the mit license"), (3, "écc by nc"), (4, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["labels"]) for i in (1, 2, 3, 4)] == [(2, 0, 3, "cc-by-nc"), (2, 0, 4, "mit"), (0, None, None, ""), (0, None, None, "gpl-3")]


def test_license_places_by_brute_force(spark):
    """Phrases among characters of one to four bytes, also at the ends and across lines."""
    r = random.Random(8)
    bits = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "NC", "😀", "é", "日本", "x1"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "  ", "-", "\n", ", ", ""]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    texts += ["😀😀😀 hello under the mit license", "😀 😀 cc by nc 4.0", "cc by nc", "é.cc-by-nc.é cc by nc", "", None] + [f"{a} under the mit license {b}" for a in ("", "😀") for b in ("", "😀 cc by nc")]
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels = ",".join(sorted({label for _, label in at}))
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), labels), t


def test_templates_by_brute_force(spark):
    """Single lines against all templates, counted plainly."""
    r = random.Random(9)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["und", "so"]
    lines = []
    for _, t in license_scan.TEMPLATES:
        for drop in (0, 0.1, 0.2, 0.25, 0.4):
            lines.append(" ".join(w if r.random() >= drop else r.choice(words) for w in t.split()))
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    for i, line in enumerate(lines):
        share = [(label, len(set(line.split()) & set(t.split())) / len(set(t.split()))) for label, t in license_scan.TEMPLATES]
        fit = {(label, round(x, 9)) for label, x in share if x >= license_scan.CONTAINMENT - 1e-9}
        assert {(m["label"], round(m["score"], 9)) for m in got[i]["matches"]} == fit


def test_wrapped_licenses(spark):
    """Notices wrapped as usual, in comments, after other text; words of different paragraphs don't make a notice."""
    wrapped = {
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "apache-2": "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES",
    }
    rows, want = [], []
    for label, text in wrapped.items():
        for near in (text, "Copyright someone\n\n" + text, "/*\n * " + text.replace("\n", "\n * ") + "\n */\nint x;", text.replace(" ", "\n")):
            rows.append((len(rows), near))
            want.append(label)
        rows.append((len(rows), text.replace("\n", "\n\n")))
        want.append("")
    rows.append((len(rows), "Mit " + "und so weiter " * 5 + "\nLicensed under the Apache License, Version 2.0."))
    want.append("apache-2")
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(rows))] == want
    assert all(got[i]["score"] >= 0.8 and len(got[i]["matches"]) == 1 for i, label in enumerate(want) if label)
    assert got[1]["matches"][0]["line"] == 2 and got[1]["score"] == 1.0


def test_many_wrapped_notices(spark):
    """Each of many wrapped notices is a match, though windows of neighbours overlap."""
    notice = "This software is provided 'as-is', without any express or\nimplied warranty. In no event will the authors be held liable for any\ndamages arising from the use of this software."
    texts = [(n, "\n".join([notice] * n)) for n in (1, 2, 7, 30)]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for n, _ in texts:
        assert len(got[n]) == n and sorted(m["line"] // 3 for m in got[n]) == list(range(n)), n


def test_dedup_ties_by_shuffle(spark, monkeypatch):
    """Rows that repeat id and length, with other columns that differ, when winners are joined by a shuffle: one of each group stays, and every row is there once."""
    monkeypatch.setattr(exact_dedup, "BROADCAST", 0)
    rows = [(i % 4, "text " + "xy"[i % 2] + " " * (i % 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(7)
    got = exact_dedup.dedup(df).collect()
    assert sorted(r["place"] for r in got) == list(range(200))
    for c in "xy":
        stays = [r for r in got if r["text"].strip()[-1] == c and r["kept"]]
        best = min((r for r in rows if r[1].strip()[-1] == c), key=lambda r: (-len(r[1]), r[0]))
        assert [(len(r["text"]), r["doc_id"]) for r in stays] == [(len(best[1]), best[0])]


def _targets(words, budget=1.5, most=2):
    """By source in order: shares by weight 5, 2, 1, and again; what is above most times its words is shared anew."""
    weight, rest, stopped = [(5, 2, 1)[i % 3] for i in range(len(words))], budget * sum(words), {}
    while len(stopped) < len(words):
        unit = rest / sum(w for i, w in enumerate(weight) if i not in stopped)
        full = [i for i in range(len(words)) if i not in stopped and weight[i] * unit >= most * words[i]]
        if not full:
            return [stopped.get(i, w * unit) for i, w in enumerate(weight)]
        stopped |= {i: most * words[i] for i in full}
        rest = budget * sum(words) - sum(stopped.values())
    return [stopped[i] for i in range(len(words))]


@pytest.mark.parametrize("bucket,run", [(2000, 50_000), (3, 4)])
def test_mix_by_brute_force(spark, bucket, run):
    """Targets, rates by bisection, and copies of each source and size, with one and several classes a size and runs a source."""
    r = random.Random(11)
    sources = ["b", "a", "é", "Z", None, "empty"]
    rows = [(i if i % 9 else None, "w " * (0 if s == "empty" else r.choice([0, 1, 5, 5, 5, 40, 300])), s) for i, s in enumerate(r.choices(sources, [50, 20, 8, 3, 5, 2], k=400))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), bucket=bucket, run=run).collect()
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in order}
    for s, target in zip(order, _targets([words[s] for s in order])):
        of = [x for x in got if x["source"] == s]
        assert len(of) == sum(x == s for _, _, x in rows) and all(x["source_size"] == words[s] and x["target"] == pytest.approx(target) for x in of)
        scale = sum(x["size"] ** 2 for x in of) / max(1, words[s])
        rate = lambda d, n: min(2.0, math.exp(min(50, d * n / max(1, scale))))
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(rate(mid, x["size"]) * x["size"] for x in of) > target else (mid, high)
        if 0 < target < 2 * words[s] * (1 - 1e-9):
            assert all(x["rate"] == pytest.approx(rate(low, x["size"]), rel=1e-4) for x in of if x["size"])
        taken = sum(x["taken"] for x in of)
        assert abs(taken - target) <= (3 if bucket == 2000 else 40 + 0.05 * target), s
        if bucket == 2000:
            behind = 0.0
            for n in sorted({x["size"] for x in of} - {0}, reverse=True):
                own = [x["copies"] for x in of if x["size"] == n]
                behind += n * sum(x["rate"] for x in of if x["size"] == n)
                want = min(2 * len(own), max(0, math.floor(behind / n + 0.5)))
                behind -= want * n
                assert sum(own) == want and max(own) - min(own) <= 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7), bucket=bucket, run=run).collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"], x["source"] or "", x["copies"])
    assert [key(x) for x in sorted(got, key=key)] == [key(x) for x in sorted(again, key=key)]


def test_mix_meets_its_targets(spark, sf_dir):
    rows = mixing.query(spark, sf_dir).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), [0, 0])
        by[r["source_size"], r["target"]][0] += r["taken"]
        by[r["source_size"], r["target"]][1] += r["size"]
    for (size, target), (taken, own) in by.items():
        assert abs(taken - target * own / size) <= 0.02 * target * own / size + 5
    again = mixing.query(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_model.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93 and all(0 <= r["score"] <= 1 for r in rows)


def test_trees_by_brute_force():
    """A tree's first cut is the best of all, its leaves are the ridge means; scores are sums of table entries, row by row."""
    r = np.random.default_rng(3)
    g, h = r.normal(size=9), r.random(9) + 0.1
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality_model.RIDGE)
    k = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    leaf = lambda a, b: g[a:b].sum() / (h[a:b].sum() + quality_model.RIDGE)
    assert quality_model.shallow_tree(g, h, 1) == pytest.approx(np.r_[[leaf(0, k)] * k, [leaf(k, 9)] * (9 - k)])
    g, h = r.normal(size=(4, 5)), r.random((4, 5)) + 0.1
    cells = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
    value = lambda i, j: sum(g[c].sum() ** 2 / (h[c].sum() + quality_model.RIDGE) for c in cells(i, j))
    i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda x: value(*x))
    got, leaves = quality_model.crossed_tree(g, h)
    assert got == pytest.approx(value(i, j)) and all(leaves[c][0, 0] == pytest.approx(g[c].sum() / (h[c].sum() + quality_model.RIDGE)) for c in cells(i, j))
    x = r.random((400, 3)).round(2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    for row, score in zip(x[:50], model.scores(x[:50])):
        z = model.base + sum(t[sum(row[k] >= e)] for k, (e, t) in enumerate(zip(map(np.array, model.edges), model.tables)) for e in [e])
        z += sum(t[int((row[i] >= a).sum()), int((row[j] >= b).sum())] for i, j, a, b, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert np.mean((model.scores(x) > 0.5) == y) > 0.9  # only a pair tells


def test_learning_from_odd_labels(spark):
    """Null and repeated labels and ids, and labels of held-out rows, which aren't used."""
    docs = spark.createDataFrame([(i, "good text here. " * (i % 5 + 3) if i % 2 else "## $$ ## " * (i % 7 + 1)) for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (5, 1), (999, 0)]
    model = quality_model.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality_model.score(docs, model).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] is not None)
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    other = quality_model.learn(docs, spark.createDataFrame([(i, 1 - q if i is not None and held(i) else q) for i, q in labels], "doc_id long, quality int"))
    assert [r["score"] for r in quality_model.score(docs, other).collect()] == [r["score"] for r in rows]


def test_fit_without_labels():
    assert quality_model.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality_model.fit(np.zeros((3, 2)), np.ones(3)).scores(np.zeros((1, 2)))[0] == pytest.approx(0.8)


def _sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingles():
    texts = ["a b c d e f", "a b", "", None, "A  B\tC\x0bd e f", "x x x x x x x x", "é è ç à ü a b c", "a b c d e", "ab a b c d", "a ba b c d"]
    values, at = shingles.shingle_sets(pa.array(texts).slice(0))
    got = [set(values[a:b].tolist()) for a, b in zip(at, at[1:])]
    want = [_sets(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_words_over_blocks(monkeypatch):
    """Words and texts that lie in several blocks have the fingerprints that they have in one."""
    r = random.Random(2)
    texts = pa.array(["".join(r.choice("ab \n") for _ in range(r.randint(0, 40))) for _ in range(100)] + [None, "", "x" * 100, "a b", "b", "", "c d"])
    want = shingles.word_hashes(texts)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(shingles, "BLOCK", size)
        got = shingles.word_hashes(texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_linkable_over_flushes_and_chunks(spark):
    """Several flushes and chunks, and a shingle that nearly all texts have, let through what one of each does."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(6))
    texts = [" ".join(word() for _ in range(r.randint(5, 40))) + " " + passage for _ in range(60)]
    texts += [t + " " + word() for t in texts[:20]] + texts[5:10] + [passage] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    one = {x["a"] for x in jaccard_join.linkable(df).collect()}
    many = {x["a"] for x in jaccard_join.linkable(df, chunk=20, flush=50).collect()}
    assert one == many and len(one) >= 40


def test_sets_of_one_first_fingerprint(spark):
    """Sets that share their first fingerprint have names of their own."""
    rows = [(1, 3, 7, 1), (2, 3, 7, 2), (3, 3, 7, 1), (4, 3, 8, 1), (5, 0, 0, 0)]
    got = {x["doc_id"]: x["id"] for x in jaccard_join.named(spark.createDataFrame(rows, "doc_id long, n long, a long, b long")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None


def brute_components(rows):
    group, sets = list(range(len(rows))), [_sets(t) for _, t in rows]

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), math.inf))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_components_of_near_copies(spark):
    """A group of near copies, of which many don't link directly, a passage that all share, short and repeated texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w + (passage if i % 3 == 0 else []))))
    rows += [(2000 + i, " ".join([word() for _ in range(r.randint(10, 200))] + passage)) for i in range(80)]
    rows += [(3000, "a b"), (3001, "A  b"), (3002, ""), (3003, None), (None, "a b"), (3004, "a b c d e"), (3000, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(repr, map(tuple, jaccard_join.components_of(df).collect())))
    assert got == sorted(map(repr, brute_components(rows)))


def test_all_links_of_near_copies(spark):
    """Every pair of documents that link, within components too."""
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "x" + str(r.randrange(1000))
        rows.append((i, " ".join(w)))
    rows += [(50, rows[0][1]), (51, "a b"), (52, "A b"), (53, None)]
    pairs, sets = jaccard_join.links_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    linked = {(x["a"], x["b"]) for x in pairs.collect()}
    of = {x["doc_id"]: x["a"] for x in sets.collect()}
    s = {d: _sets(t) for d, t in rows}
    for i in s:
        for j in s:
            if i < j and s[i] and s[j]:
                n = len(s[i] & s[j])
                want = 100 * n >= 75 * (len(s[i]) + len(s[j]) - n)
                assert want == (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in linked), (i, j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = {"": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    now = docs[""]
    from weblathe.llm.common import kept

    steps = []
    for name, stage in c.STAGES:
        now = kept(stage(spark, now, sf_dir))
        steps.append(now)
    rules, exact, near, mixed, coded = steps
    assert all(s.columns == c.COLUMNS for s in steps[:4])
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(rules) == sorted(r["doc_id"] for r in docs[""].collect() if _passes(r["text"] or "", r["lang"]))
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in exact.collect()]
    best = {}
    for r in rules.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert ids(exact) == sorted(d for _, d in best.values()) and len(texts) == len(set(texts))
    want = {x[2] for x in brute_components([(r["doc_id"], r["text"]) for r in exact.collect()])}
    assert {r["doc_id"] for r in near.collect()} == want and near.count() == len(want)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    assert ids(mixed) == sorted(d for d, n in copies.items() for _ in range(n)) and max(copies.values()) <= 2
    words = lambda df: df.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert abs(words(mixed) / words(near) - 1.5) < 0.02
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    source = {r["doc_id"]: r["text"] for r in near.collect()}
    rows = coded.collect()
    assert len(rows) == mixed.count() and all(r["ids"] == lib.encode(source[r["doc_id"]]) and r["round_trip"] for r in rows)


def _passes(text, lang):
    """The quality rules, plainly."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = max(1, len(w))
    stop = sum(x.lower() in quality_rules.STOP_WORDS for x in w) / n >= 0.01 or len(w) < 60 or lang not in quality_rules.LANGUAGES
    return len(w) >= 10 and 100 * repeated <= 20 * len(w) and 2 <= sum(map(len, w)) / n <= 20 and sum(text.count(x) for x in "#*$%&|<>") / n <= 0.2 and stop and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids and texts go through every stage; an empty table too."""
    import corpus_pipeline as c

    r = random.Random(12)
    text = lambda: " ".join(r.choice(["the", "and", "of"]) if k % 3 == 0 else "".join(r.choice("abcdefgh") for _ in range(5)) for k in range(80))
    one, two, three = text(), text(), text()
    rows = [(1, one), (None, one + " more"), (None, two), (9, three), (9, text()), (None, None), (None, ""), (9, three), (4, three + "  "), (None, two + " again")]
    rows = [(d, t, "en", "s" if (d or 0) % 2 else None, 0) for d, t in rows]
    for docs, n in ((spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 4), (spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), 0)):
        for k, (_, stage) in enumerate(c.STAGES):
            docs = stage(spark, docs, "")
            docs.write.parquet(path := f"{tmp_path}/{n}-{k}")
            docs = spark.read.parquet(path)
            if k == 2:
                left = sorted(map(tuple, docs.select("doc_id", "text").collect()), key=repr)
                assert len(left) == n and (not n or [t for _, t in left if t.startswith(one)] == [one])
        assert docs.columns == ["doc_id", "lang", "source", "ids", "n_ids", "text", "round_trip"]
