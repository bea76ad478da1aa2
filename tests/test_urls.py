import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.functions import weburl as U


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalise(spark):
    """Urls put together from parts: scheme and host in lower case, no default port, a path at least, no empty query, dot segments gone."""
    cases = {}
    for scheme, default in (("http", "80"), ("HTTPS", "443"), ("Ftp", None)):
        for host in ("moss.test", "FERN.Test", "me:Key@Fern.test"):
            for port in ("", "80", "443", "8123"):
                for path, clean in (("", "/"), ("/", "/"), ("/Up/./x/../y", "/Up/y"), ("/..", "/"), ("/ä b", "/ä b")):
                    for tail, left in (("", ""), ("?", ""), ("?K=ö", "?K=ö"), ("#F", "#F"), ("?#F", "#F")):
                        own = host.rpartition("@")
                        where = own[0] + own[1] + own[2].lower()
                        shown = f":{port}" if port and port != default else ""
                        cases[f"{scheme}://{host}{':' + port if port else ''}{path}{tail}"] = f"{scheme.lower()}://{where}{shown}{clean}{left}"
    cases |= {"moss": None, "http:///moss": None, None: None, "\t http://moss.test/x \n": "http://moss.test/x"}
    got = dict(values(spark, [(k,) for k in cases], "u string", "u", U.normalise(F.col("u"))))
    assert {k: (got[k], v) for k, v in cases.items() if got[k] != v} == {}


def test_canonical(spark):
    assert values(spark, [("https://a.b/x?y#z",)], "u string", U.canonical(F.col("u"))) == [("http://a.b/x?y",)]


def test_join_is_the_standard_one(spark):
    bases = ["http://a.b/c/d?q#f", "http://a.b", "http://a.b/", "https://a.b/c/d/"]
    refs = ["x", "/x", "//h/x", "?y", "#z", "../x", "./x", "g;p?y#s", "http://o/p", "..", "../../../x", "", "x/./y/../z", "mailto:x@y"]
    rows = [(b, r) for b in bases for r in refs]
    got = values(spark, rows, "b string, r string", U.join(F.col("b"), F.col("r")))
    want = [urljoin(b, r) for b, r in rows]
    odd = [(x, g[0], w) for x, g, w in zip(rows, got, want) if g[0] != w]
    assert not [x for x in odd if x[0] not in {("http://a.b", "x"), ("http://a.b", "..")}], odd


def test_extension(spark):
    cases = {"index.html": "html", ".html": "", "a.b.c": "c", "path": "", "": "", "..x": "", ".a.b": "b", "x.": ""}
    assert dict(values(spark, [(k,) for k in cases], "n string", "n", U.extension(F.col("n")))) == cases


@pytest.mark.parametrize("a,b,want", [("/foo", "/bar", None), ("/foo", "/foobar", None), ("/foo", "/foo", 0), ("/foo", "/foo/bar", -1), ("/foo/bar", "/foo", 1), ("/foo/", "/foo/bar", None), ("/foo/bar", "/foo/", None)])
def test_path_distance(spark, a, b, want):
    d = U.path_distance(F.lit("h"), F.col("a"), F.lit("h"), F.col("b"))
    assert values(spark, [(a, b)], "a string, b string", d) == [(want,)]


def test_relative(spark):
    cases = [("h/a/b.html", "h/a/c.html", "./b.html"), ("h/x.html", "h/a/c.html", "./../x.html"), ("k/x.html", "h/a/c.html", "./../../k/x.html"), ("h/index.html", "h/index.html", "./index.html")]
    assert [x[0] for x in values(spark, [c[:2] for c in cases], "t string, f string", U.relative(F.col("t"), F.col("f")))] == [c[2] for c in cases]


def test_numbers():
    assert [T.number(x) for x in ("1", "1K", "1k", "2M", "1G", "abc", "", "1.5k")] == [1, 1000, 1000, 2e6, 1e9, None, None, 1500]


@pytest.mark.parametrize("pattern,text,want", [("*o", "foo", True), ("foo", "foo", True), ("f?o", "foo", True), ("[a-f]oo", "foo", True), ("[!a-f]oo", "foo", False), ("a.b", "axb", False), ("*", "a\nb", True), ("f*", "Foo", False), ("*[", "x[", True)])
def test_glob(spark, pattern, text, want):
    assert values(spark, [(text,)], "t string", T.glob(F.col("t"), pattern)) == [(want,)]


def test_http_date(spark):
    """All three forms of a date, of many days."""
    days = [datetime.datetime(1994 + 5 * i, 1 + i % 12, 1 + (7 * i) % 28, i, 2 * i, 3 * i) for i in range(12)]
    rows = [(d.strftime(f), str(d)) for d in days for f in ("%a, %d %b %Y %H:%M:%S GMT", "%A, %d-%b-%y %H:%M:%S GMT", "%a %b %e %H:%M:%S %Y")] + [("no", None), (None, None), ("Tue, 41 Jan 2030 08:00:00 GMT", None)]
    assert values(spark, rows, "t string, d string", T.http_date(F.col("t")).cast("string"), F.col("d")) == [(d, d) for _, d in rows]
