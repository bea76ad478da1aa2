"""The jar as keyed state: which cookies go with which request, merging, modes, and a whole run against a server."""

import http.cookies
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from weblathe import cli
from weblathe.sources import cookies as C
from weblathe.sources import http as web
from weblathe.sources import state

JAR = state.TABLES["cookies"]


@pytest.fixture
def server():
    """Pages that set cookies, and tell which they were sent."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["Cookie"]))
            path = self.path.partition("?")[0]
            self.send_response(302 if path == "/hop" else 200)
            for c in {"/": ["a=1", "deep=2; Path=/deep", "secret=3; Secure", "old=4; Max-Age=0"], "/out": ["a=; Max-Age=0"], "/hop": ["hop=5"], "/two": ["a=two"], "/one": ["a=one"], "/other": ["x=6; Domain=example.com"]}.get(path, []):
                self.send_header("Set-Cookie", c)
            if path == "/hop":
                self.send_header("Location", "/landing")
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<a href=/x><a href=/deep/y>" if path == "/" else b"")

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def _wave(spark, jar, at, *paths):
    requests = spark.createDataFrame([(at + p,) for p in paths], "url string")
    got = spark.createDataFrame(web.fetch(jar.sent(requests), partitions=2).select("url", "set_cookies").collect(), f"url string, set_cookies array<{C.COOKIE}>")
    jar.take(got)
    return got


def _sent(asked):
    return {p: {k: m.value for k, m in http.cookies.SimpleCookie(c or "").items()} for p, c in asked}


@pytest.mark.parametrize("mode", C.MODES)
def test_modes(spark, tmp_path, server, mode):
    """Sent and kept by mode: from earlier runs unless blocked, within the run and after it."""
    at, asked = server
    m = str(tmp_path)
    state.write(spark.createDataFrame([("127.0.0.1", True, "/", "stored", "0", False, None)], JAR), m, "cookies")
    jar = C.Jar(spark, m, mode, now=1_900_000_000)
    _wave(spark, jar, at, "/")
    _wave(spark, jar, at, "/x", "/deep/y", "/deeper")
    jar.save()
    old = {} if mode == "block" else {"stored": "0"}
    new = {"a": "1"} if mode in ("persist", "accept") else {}
    assert _sent(asked) == {"/": old, "/x": old | new, "/deep/y": old | new | ({"deep": "2"} if new else {}), "/deeper": old | new}
    left = {r["name"] for r in C.Jar(spark, m, "persist").table.collect()}
    assert left == ({"stored", "a", "deep", "secret"} if mode == "persist" else {"stored"})


def test_redirects_carry_and_servers_take_back(spark, tmp_path, server):
    """A redirect's cookie is sent to its target; a server's own cookies for other domains are refused; an expired one goes; of one wave's values the last url's counts."""
    at, asked = server
    jar = C.Jar(spark, str(tmp_path), now=1_900_000_000)
    _wave(spark, jar, at, "/hop", "/other")
    assert _sent(asked)["/landing"] == {"hop": "5"} and {r["name"] for r in jar.table.collect()} == {"hop"}
    for _ in range(2):
        _wave(spark, jar, at, "/two", "/one")
        assert {r["name"]: r["value"] for r in jar.table.collect()} == {"hop": "5", "a": "two"}
    _wave(spark, jar, at, "/out")
    assert {r["name"] for r in jar.table.collect()} == {"hop"}


def test_matching_by_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.garden.test", "garden.test", "b.a.garden.test", "ngarden.test", "127.0.0.1"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/a/b/c"]
    jar = [(r.choice(hosts), r.random() < 0.5, r.choice(paths), f"n{i}", "v", r.random() < 0.3, r.choice([None, 50, 200])) for i in range(60)]
    urls = [f"{s}://{u}{h}{port}{p}{q}" for s in ("http", "https") for u in ("", "u:p@") for h in (*hosts, "GARDEN.test") for port in ("", ":8080") for p in ("", *paths) for q in ("", "?/a/b")]

    def fits(c, url):
        domain, only, prefix, _, _, secure, expires = c
        scheme, rest = url.split("://")
        netloc, slash, path = rest.partition("?")[0].partition("/")
        host, path = netloc.rpartition("@")[2].partition(":")[0].lower(), "/" + path if slash else "/"
        on = host == domain or not only and host.endswith("." + domain)
        under = path == prefix or path.startswith(prefix) and (prefix.endswith("/") or path[len(prefix)] == "/")
        return on and under and (not secure or scheme == "https") and (expires is None or expires > 100)

    got = {x["url"]: [c["name"] for c in x["cookies"] or []] for x in C.sent(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(jar, JAR), 100).collect()}
    for u in urls:
        want = [c for c in jar if fits(c, u)]
        assert set(got[u]) == {c[3] for c in want}
        sizes = {c[3]: len(c[2]) for c in jar}
        assert [sizes[n] for n in got[u]] == sorted((sizes[n] for n in got[u]), reverse=True)


def test_merging(spark):
    """By domain, path and name; later urls and places win, and what has expired goes."""
    old = [("h", True, "/", "a", "0", False, None), ("h", True, "/", "b", "0", False, 90), ("h", True, "/p", "a", "0", False, None)]
    new = [("u2", [("h", True, "/", "a", "2", False, None)]), ("u1", [("h", True, "/", "a", "1", False, None), ("h", True, "/", "c", "1", False, 500), ("h", True, "/", "c", "2", False, 500)]), ("u3", [("h", True, "/p", "a", "", False, 0)]), ("u4", None)]
    made = C.merged(spark.createDataFrame(old, JAR), spark.createDataFrame(new, f"url string, set_cookies array<{C.COOKIE}>"), 100)
    assert {(r["path"], r["name"]): r["value"] for r in made.collect()} == {("/", "a"): "2", ("/", "c"): "2"}
    assert made.filter(F.col("name") == "c").count() == 1


def test_a_run_keeps_its_cookies(spark, tmp_path, server):
    """Waves of a crawl see what the waves before were given, and the next run starts with it."""
    at, asked = server
    cli.run(spark, cli.parse(["-O", str(tmp_path / "m"), "--no-live-update", at + "/", "@follow", "+"]))
    sent = _sent(asked)
    assert sent == {"/": {}, "/x": {"a": "1"}, "/deep/y": {"a": "1", "deep": "2"}}
    assert {r["name"] for r in state.read(spark, str(tmp_path / "m"), "cookies").collect()} == {"a", "deep", "secret"}
