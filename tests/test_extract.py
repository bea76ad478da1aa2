"""Extraction and rewriting, over documents that are put together from forms and urls."""

import html
import itertools

import pytest
from pyspark.sql import functions as F

from weblathe.functions import scanners as S
from weblathe.operators import extract

NAMES = ["leaf.svg", "a/b-2.png", "wo rd.gif", "q?k=v&w", "é/ü.css", "tick'et", 'say"so']
#: How a style sheet names a url: a form, what it does to the url, and which characters it can't hold.
SHEETS = [
    ('url("%s")', lambda u: u.replace('"', '\\"'), ""), ("url('%s')", lambda u: u.replace("'", "\\'"), ""), ("url(%s)", str, "'\" )"), ("url(  %s)", str, "'\" )"),
    ('@import "%s"', lambda u: u.replace('"', '\\"'), ""), ("@import '%s'", lambda u: u.replace("'", "\\'"), ""), ("@import url(%s)", str, "'\" )"),
]


def sheets():
    for (form, escape, without), name in itertools.product(SHEETS, NAMES):
        if not set(name) & set(without):
            yield form % escape(name), name


def test_css():
    made = list(sheets())
    text = "\n".join(f"/* url(no{i}) @import 'no' */ .k{i} {{ margin: 0 }} {rule};" for i, (rule, _) in enumerate(made)) + " /* url(open"
    assert [u for _, _, u in S.css(text)] == [u for _, u in made]
    assert S.css("") == S.css("p { color: red }") == [] and S.css("url()") == []


#: Elements that name a url: markup with {}, whether the page needs it, whether it isn't to be followed.
ELEMENTS = [
    ("<a href={}>", False, False), ("<AREA shape=rect HREF={} />", False, False), ("<img alt=x src={}>", True, False), ("<script src={}></script>", True, False), ("<iframe src={}></iframe>", True, False),
    ("<td background={}>", True, False), ("<object data={}></object>", True, False), ("<form method=post action={}>", False, True), ("<link rel=icon href={}>", True, False), ("<link rel='next x' href={}>", False, False),
    ("<link rel='x STYLESHEET' href={}>", None, False),
]
QUIET = ["text", "<!-- <a href=no> -->", "<script>x = '<img src=no>'</script>", "<p title='<a href=no>'>", "<a name=no>", "<!doctype html>", "a < b", "</a href=no>", "<style>p{margin:0}</style>"]


def quoted(name):
    yield '"' + html.escape(name) + '"'
    yield "'" + html.escape(name) + "'"
    if not set(name) & set("\"' >&"):
        yield name


def pages():
    """(document, [(url, inline, do_not_follow)]): every element with every name and quote, and what names no url between them."""
    noise = itertools.cycle(QUIET)
    for markup, inline, no in ELEMENTS:
        parts, want = [], []
        for name in NAMES:
            for q in quoted(name):
                parts += [next(noise), markup.format(q)]
                want.append((name, inline, no))
        yield "".join(parts), want


def test_html(spark):
    made = list(pages())
    df = spark.createDataFrame([(i, "http://garden.test/d/", h, "text/html") for i, (h, _) in enumerate(made)], "i int, url string, content string, mime string")
    got = {}
    for r in extract.extract_links(df).orderBy("i", "n").collect():
        got.setdefault(r["i"], []).append((r["raw"], r["inline"], r["do_not_follow"]))
    for i, (h, want) in enumerate(made):
        assert [x[::2] for x in got[i]] == [x[::2] for x in want], h
        assert all(w[1] in (g[1], None) for g, w in zip(got[i], want)), h
        assert S.rewritten(h, False, {"other": "x"}) == h


def test_bases_and_styles(spark):
    """A base holds from where it stands on; style attributes and elements are sheets; a refresh names a url."""
    made = []
    for rule, name in sheets():
        made.append((f"<div style=\"{html.escape(rule)}\">", [f"http://garden.test/{name}"]))
        made.append((f"<base href='http://other.test/x/'><style>{rule}</style>", [f"http://other.test/x/{name}"]))
    made += [(f"<meta http-equiv=REFRESH content='{n}; URL={u}'>", [f"http://garden.test/{u}"]) for n in (0, 15) for u in ("later.html", "deep/")]
    made += [("<meta name=refresh content='5; url=no'>", []), ("<meta http-equiv=refresh content='5'>", []), ("<base href='/up/'><a href=in>", ["http://garden.test/up/in"])]
    df = spark.createDataFrame([(i, "http://garden.test", h, "text/html") for i, (h, _) in enumerate(made)], "i int, url string, content string, mime string")
    got = {}
    for r in extract.extract_links(df).orderBy("i", "n").collect():
        got.setdefault(r["i"], []).append(r["absolute"])
    for i, (h, want) in enumerate(made):
        assert got.get(i, []) == want, h


@pytest.mark.parametrize("new", ["n.html", 'with"quote', "it's", "a&b"])
def test_rewriting_is_found_again(new):
    """After rewriting, the scanner finds the new url where the old one was, and nothing else has changed."""
    for h, want in pages():
        changed = S.rewritten(h, False, {name: new for name, _, _ in want})
        assert [(m.raw, m.inline) for m in S.html_mentions(changed)] == [(new, m.inline) for m in S.html_mentions(h)]
        back = {new: want[0][0]}
        assert S.html_mentions(S.rewritten(changed, False, back))[0].raw == want[0][0]
    if "'" not in new and '"' not in new:
        for rule, name in sheets():
            assert [u for _, _, u in S.css(S.rewritten(rule, True, {name: new}))] == [new]
            h = f"<style>{rule}</style>"
            assert [m.raw for m in S.html_mentions(S.rewritten(h, False, {name: new}))] == [new]


def test_registered_types_are_rewritten_too(spark, monkeypatch):
    monkeypatch.setitem(extract._EXTRACTORS, "text/x-lines", lines)
    df = spark.createDataFrame([("u", "-> one\n-> two", "text/x-lines")], "url string, content string, mime string")
    assert [r["raw"] for r in extract.extract_links(df).orderBy("n").collect()] == ["one", "two"]
    new = F.create_map(F.lit("two"), F.lit("three"))
    assert df.select(extract.rewrite_links(F.col("content"), F.col("mime"), new)).first()[0] == "-> one\n-> three"


def lines(text):
    out, at = [], 0
    for x in text.split("\n"):
        out.append(S.Mention(at + 3, len(x) - 3, x[3:], False, None, False, None, "plain"))
        at += len(x) + 1
    return out


def test_round_trip_of_all_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    same = extract.rewrite_links(F.col("html"), F.lit("text/html"), F.create_map(F.lit("none"), F.lit("x")))
    assert p.filter(same != F.col("html")).count() == 0


def test_documents_go_to_workers_in_batches_of_bounded_size(spark):
    from pyspark.sql import functions as F

    from weblathe.operators import extract

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    extract.mentions(F.col("html"), F.lit("text/html"))

    @F.arrow_udf("long")
    def rows_of_batch(texts):
        import pyarrow as pa

        return pa.array([len(texts)] * len(texts), pa.int64())

    pages = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("html"))
    assert pages.select(rows_of_batch("html").alias("n")).agg(F.max("n")).first()[0] <= 6
    spark.conf.set(name, "1000000")
    extract.mentions(F.col("html"), F.lit("text/html"))
    assert spark.conf.get(name).removesuffix("b") == "1000000"  # what was asked for stays
    spark.conf.unset(name)
