"""Whole runs of the command line, over a table of responses and over a server of this machine."""

import http.server
import threading

import pytest

from weblathe import cli
from weblathe.sources import state
from weblathe.sources.files import delete_files, write_files

S = "url string, status int, headers map<string,string>, content binary, redirects array<string>, error string, redirect_code int"
G = "http://garden.test/"


def responses(spark, path, pages):
    """pages: name -> (content, headers, redirect target and code, status)."""
    rows = []
    for name, (content, headers, moved, status) in pages.items():
        to, code = moved or (None, None)
        rows.append((G + name, status, {"content-type": "text/html"} | headers, content if isinstance(content, bytes) else content.encode(), [G + to] if to else [], None, code))
    spark.createDataFrame(rows, S).write.mode("overwrite").parquet(path)


def page(content, headers=None, moved=None, status=200):
    return content, headers or {}, moved, status


def run(spark, tmp_path, *args, now="2030-01-01 00:00:00"):
    done = cli.run(spark, cli.parse(["-O", str(tmp_path / "m"), "--no-live-update", "--responses", str(tmp_path / "r"), *args]), now)
    return {r["url"].removeprefix(G): r["status"] for r in done.log.filter("status <> 'duplicate'").collect()}


def files(tmp_path):
    root = tmp_path / "m"
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file() and ".state" not in p.parts}


def test_runs_and_updates(spark, tmp_path):
    """A first run writes files, tables and an index; an update asks for what has changed, keeps the rest, and deletes what is gone."""
    first = {
        "": page('<a href="a">A</a><a href="moved">M</a><a href="/out">O</a><img src="p.png">', {"etag": "1"}), "a": page("<a href=\"/b#x\">B</a>", {"etag": "2"}), "b": page("caf\u00e9".encode("latin-1"), {"content-type": "text/html; charset=iso-8859-1"}),
        "moved": page("", moved=("a", 301)), "p.png": page(b"\x89PNG\xff", {"content-type": "image/png"}), "out": page("gone", status=404),
    }
    responses(spark, str(tmp_path / "r"), first)
    status = run(spark, tmp_path, G, "--enable-delete", "@follow", "+")
    assert status["out"] == "http-error" and status["moved"] == "redirect" and status["p.png"] == "success"
    got = files(tmp_path)
    assert set(got) == {"garden.test/index.html", "garden.test/a.html", "garden.test/b.html", "garden.test/p.png", "index.html"}
    assert got["garden.test/index.html"] == b'<a href="./a.html">A</a><a href="./a.html">M</a><a href="http://garden.test/out">O</a><img src="./p.png">'
    assert got["garden.test/a.html"] == b'<a href="./b.html#x">B</a>' and got["garden.test/b.html"] == "caf\u00e9".encode("latin-1") and got["garden.test/p.png"] == b"\x89PNG\xff"
    assert got["index.html"].count(b"<a href") == 4
    m = str(tmp_path / "m")
    assert [tuple(r) for r in state.read(spark, m, "redirects").collect()] == [(G + "moved", 301, G + "a")]
    assert {r["url"]: r["encoding"] for r in state.read(spark, m, "url_info").collect()}[G + "b"] == "iso-8859-1"
    # an update: the start page is as it was, its stored links lead on; a has new content and no longer leads to b
    second = first | {"a": page("<a href=c>C</a>", {"etag": "3"}), "c": page("new")}
    responses(spark, str(tmp_path / "r"), second)
    status = run(spark, tmp_path, G, "--update")
    assert status[""] == "not-modified" and status["a"] == status["c"] == "success" and "b" not in status
    got = files(tmp_path)
    assert set(got) == {"garden.test/index.html", "garden.test/a.html", "garden.test/c.html", "garden.test/p.png", "index.html"} and b"b.html" not in got["index.html"]
    assert got["garden.test/a.html"] == b'<a href="./c.html">C</a>' and got["garden.test/index.html"].startswith(b'<a href="./a.html">')
    assert {r["filename"] for r in state.read(spark, m, "documents").collect()} == set(got) - {"index.html"}
    assert {r["url"].removeprefix(G) for r in state.read(spark, m, "url_info").collect()} == {"", "a", "c", "p.png"}


def test_expiry_is_compared_with_the_time_of_the_run(spark, tmp_path):
    pages = {"": page("<a href=a>"), "a": page("x", {"expires": "Tue, 01 Jan 2030 08:00:00 GMT"})}
    responses(spark, str(tmp_path / "r"), pages)
    run(spark, tmp_path, G, "--trust-expires", "@follow", "+")
    assert run(spark, tmp_path, G, "--update", now="2030-01-01 07:00:00")["a"] == "not-expired"
    assert run(spark, tmp_path, G, "--update", now="2030-01-01 09:00:00")["a"] == "success"


def test_local_files_lead_on_but_are_not_mirrored(spark, tmp_path):
    (tmp_path / "start.html").write_text("<a href=a>")
    responses(spark, str(tmp_path / "r"), {"a": page("x")})
    status = run(spark, tmp_path, f"{tmp_path}/start.html{{{G}}}", "@follow", "+")
    assert status == {"": "success", "a": "success"} and set(files(tmp_path)) == {"garden.test/a.html", "index.html"}


def test_files_stay_in_the_mirror(spark, tmp_path):
    rows = [("a/b/c.txt", b"1"), ("../out", b"2"), (".state/x", b"3"), ("/abs", b"4"), ("a/d.txt", b"5"), ("a/b/e.txt", None)]
    got = {r["filename"]: r["bytes"] for r in write_files(spark.createDataFrame(rows, "filename string, content binary"), str(tmp_path)).collect()}
    assert got == {"a/b/c.txt": 1, "../out": -1, ".state/x": -1, "/abs": -1, "a/d.txt": 1, "a/b/e.txt": 0}
    gone = delete_files(spark.createDataFrame([("a/b/c.txt",), ("a/b/e.txt",), ("nothing",)], "filename string").coalesce(1), str(tmp_path))
    assert {r["filename"]: r["gone"] for r in gone.collect()} == {"a/b/c.txt": True, "a/b/e.txt": True, "nothing": False}
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["d.txt"]


@pytest.fixture
def server():
    """Pages of this machine that count requests, redirect, fail and answer conditional requests."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"], self.headers["If-None-Match"]))
            body = {"/": b"<a href=/one><a href=/moved><a href=/none><img src=/loop>", "/one": b"<a href=/>one", "/two": b"two"}.get(self.path)
            if self.headers["If-None-Match"] == "tag-one" and self.path == "/one":
                self.send_response(304)
            elif self.path in ("/moved", "/loop"):
                self.send_response(301)
                self.send_header("Location", "/two" if self.path == "/moved" else "/loop")
            else:
                self.send_response(200 if body else 404)
                self.send_header("Content-Type", "text/html")
                if self.path == "/one":
                    self.send_header("ETag", "tag-one")
            self.end_headers()
            self.wfile.write(body or b"")

        def do_POST(self):
            asked.append((self.path, self.headers["User-Agent"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<a href=/one>")

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_live_crawl(spark, tmp_path, server):
    """Each page is asked for once a run, by the agent's name; an update asks conditionally."""
    at, asked = server
    options = ["-O", str(tmp_path / "m"), "--no-live-update", "--user-agent", "gardener/1", at]
    done = cli.run(spark, cli.parse([*options, "@follow", "+"]))
    status = {r["url"].removeprefix(at): r["status"] for r in done.log.filter("status <> 'duplicate'").collect()}
    assert status == {"/": "success", "/one": "success", "/moved": "redirect", "/two": "success", "/none": "http-error", "/loop": "redirect-error"}
    assert {a for _, a, _ in asked} == {"gardener/1"} and sum(p == "/one" for p, _, _ in asked) == sum(p == "/" for p, _, _ in asked) == 1
    assert any(p.read_bytes() == b"two" for p in (tmp_path / "m").rglob("two.html"))
    asked.clear()
    done = cli.run(spark, cli.parse([*options, "--update"]))
    assert {r["url"].removeprefix(at): r["status"] for r in done.log.collect()}["/one"] == "not-modified" and ("/one", "gardener/1", "tag-one") in asked


def test_data_is_sent(spark, tmp_path, server):
    at, asked = server
    done = cli.run(spark, cli.parse(["-O", str(tmp_path / "m"), "--no-live-update", at + "/form{seed=moss,n=2}", "@follow", "+depth<2"]))
    assert asked[0][0] == "/form" and asked[0][2] == "seed=moss&n=2"
    assert {r["url"].removeprefix(at): r["status"] for r in done.log.collect()} == {"/form": "success", "/one": "success", "/": "rule-deny"}
