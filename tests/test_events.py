"""What observers are told of links, policies as classes, and what requests carry on the live web."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tests.test_crawl import E, saved, web
from weblathe.operators import events as V
from weblathe.operators import extract
from weblathe.operators.crawl import Crawl, seeds
from weblathe.operators.policy import Policy
from weblathe.plans.rules import RuleList
from weblathe.sources import http as source

LINKS = {"": ["a", "b", ("form", False, True), "old", "gone"], "a": ["b", "c", ""], "b": ["a"], "c": ["d"]}


class Diary(V.Observer):
    """Writes what it is told to a file for each task."""

    def __init__(self, place):
        self.place = place

    def open(self):
        import uuid

        self.file = open(f"{self.place}/{uuid.uuid4().hex}", "w")

    def close(self):
        self.file.close()

    def _say(self, event, link, **state):
        self.file.write(json.dumps([event, link["url"].removeprefix(E), link["depth"], {k: v for k, v in state.items() if k != "tests"}, [t["rule"] for t in state.get("tests", [])]]) + "\n")

    def added_to_queue(self, link):
        self._say("added", link)

    def taken_by_processor(self, link):
        self._say("taken", link)

    def follow_state_changed(self, link, **state):
        self._say("follow", link, **state)

    def save_state_changed(self, link, **state):
        self._say("save", link, **state)

    def bail_state_changed(self, link, **state):
        self._say("bail", link, **state)

    def completed(self, link):
        self._say("completed", link)


def one_by_one(links, moved, gone, denied, stop):
    """A sequential crawl that tells of each link, by link: page -> [(event, state)], and how often each page was added."""
    told, added, known, queue = [], [""], set(), [("", False)]
    while queue:
        page, no = queue.pop(0)
        mine = []
        told.append((page, mine))
        mine.append(("taken", {}))
        state = {"skipped": "no-download"} if no else {"skipped": "duplicate"} if page in known else {"skipped": "rule-deny"} if page == denied else None
        if state is None and page in moved:
            state = {"failed": "redirect", "code": 200}
            queue.insert(0, (moved[page], False))
            added.append(moved[page])
        elif state is None and page in gone:
            state = {"failed": "http-error", "code": 404}
        mine.append(("follow", state or {"success": True, "code": 200}))
        if state is None:
            known.add(page)
            mine.append(("save", {"saved": True}))
            if page == stop:
                mine.append(("bail", {"bail": True}))
            else:
                found = [(x, False) if isinstance(x, str) else (x[0], x[2]) for x in links.get(page, [])]
                new = [x for x in found if x[0] not in known]
                mine.append(("bail", {"links_total": len(found), "links_followed": len(new)}))
                queue += new
                added += [x for x, _ in new]
        mine.append(("completed", {}))
    return told, added


def test_observers_are_told_what_a_queue_would_tell(spark, tmp_path):
    moved = {"old": "new"}
    r, links = web(spark, LINKS, status={"gone": 404}, moved=moved)
    follow = RuleList(["+", "-path=/d"])
    Crawl(r, links, follow, stop=["-", "+path=/b"], on_wave=V.observed(Diary(str(tmp_path)), {"follow": follow})).run(seeds(spark, [E]))
    told = [[json.loads(x) for x in open(tmp_path / f)] for f in os.listdir(tmp_path)]
    want, added = one_by_one(LINKS, moved, {"gone"}, "d", "b")
    got = []
    for task in told:  # within a task, a link's events come together and in order
        for event, page, _, state, tests in task:
            if event == "taken":
                got.append((page, []))
                assert not tests
            if event == "follow":
                assert tests == ["+", "-path=/d"]
            if event != "added":
                assert got[-1][0] == page
                got[-1][1].append((event, state))
    key = lambda x: json.dumps(x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(page for task in told for event, page, *_ in task if event == "added") == sorted(added)


def test_recorded_events(spark, tmp_path):
    """Waves of events as a table, which running a wave again doesn't change; an empty wave and rules about responses."""
    r, links = web(spark, {"": ["a"]})
    record, waves = V.recorded(str(tmp_path / "e")), []

    def twice(*wave):
        record(*wave), record(*wave)
        waves.append(wave)

    Crawl(r, links, ["+"], on_wave=twice).run(seeds(spark, [E]))
    rows = spark.read.parquet(str(tmp_path / "e")).orderBy("wave", "depth", "order", "step", "n").collect()
    one = ["taken_by_processor", "follow_state_changed", "save_state_changed", "bail_state_changed"]
    assert [x["event"] for x in rows] == ["added_to_queue", *one, "added_to_queue", "completed", *one, "completed"]
    assert V.events_of(waves[0][1].limit(0), waves[0][2].limit(0)).count() == 0
    with pytest.raises(ValueError):
        V.events_of(*waves[0][1:], {"save": RuleList(["+size>1k"])})


class Gardener(Policy):
    def follow(self):
        return ["+", "-content-type=image/*"]

    def save(self):
        return ~F.col("path").endswith("/secret")

    def stop(self):
        return ["-", "+path=/end"]

    def configure_session(self):
        return {"User-Agent": "gardener/2", "X-Site": "all"}

    def configure_request(self):
        return F.when(F.col("path") == "/one", F.create_map(F.lit("x-site"), F.col("netloc"), F.lit("X-Depth"), F.col("depth").cast("string")))


def test_policies_over_a_table(spark):
    r, links = web(spark, {"": ["a", "secret", "end"], "end": ["b"]})
    r = r.withColumn("headers", F.create_map(F.lit("content-type"), F.when(F.col("url").endswith("/a"), "image/png").otherwise("text/html")))
    assert saved(Gardener().crawl(r, links).run(seeds(spark, [E]))) == ["", "end"]
    assert saved(Policy().crawl(r, links).run(seeds(spark, [E]))) == [""]  # the default follows requisites only


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self, head=False):
            asked.append((self.command, self.path, {k.lower(): v for k, v in self.headers.items()}))
            kind = "image/png" if self.path.startswith("/image") else "text/html"
            body = {"/": b"<a href=/one><a href=/image1><a href=/end><a href=/none>", "/one": b"<a href=/two><a href=/image2>", "/end": b"<a href=/three>"}.get(self.path, b"x")
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_headers_decide_before_bodies_are_asked_for(spark, server):
    """Rules about headers cost a HEAD; only what they let through is loaded, and each of both once. Requests carry referers and what the policy says."""
    at, asked = server
    crawl = Gardener().crawl(fetch=lambda requests: source.fetch(requests, partitions=2), links_of=extract.links_of)
    done = crawl.run(seeds(spark, [at + "/"]))
    status = {x["url"].removeprefix(at): x["status"] for x in done.log.collect()}
    assert status == {"/": "success", "/one": "success", "/image1": "rule-deny", "/end": "success", "/none": "http-error", "/two": "success", "/image2": "rule-deny"}
    assert sorted(p for m, p, _ in asked if m == "GET") == ["/", "/end", "/one", "/two"]
    assert sorted(p for m, p, _ in asked if m == "HEAD") == ["/end", "/image1", "/image2", "/none", "/one", "/two"]
    headers = {p: h for m, p, h in asked if m == "GET"}
    assert {h["user-agent"] for _, _, h in asked} == {"gardener/2"}
    assert "referer" not in headers["/"] and headers["/one"]["referer"] == at + "/" and headers["/two"]["referer"] == at + "/one"
    assert headers["/one"]["x-site"] == at.removeprefix("http://") and headers["/one"]["x-depth"] == "1" and headers["/two"]["x-site"] == "all" and "x-depth" not in headers["/two"]


def test_bodies_are_asked_for_where_a_rule_reads_them(spark, server):
    at, asked = server
    crawl = Crawl(None, None, ["+", "-content=*two*"], fetch=lambda requests: source.fetch(requests, partitions=2), links_of=extract.links_of, max_depth=1)
    done = crawl.run(seeds(spark, [at + "/"]))
    assert {x["url"].removeprefix(at): x["status"] for x in done.log.collect()}["/one"] == "rule-deny" and {m for m, _, _ in asked} == {"GET"}
