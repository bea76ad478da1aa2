import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weblathe.operators import crawl as crawl_module
from weblathe.operators import crawl_log, mirror
from weblathe.operators.crawl import Crawl, CrawlError, seeds
from weblathe.operators.known import Known
from weblathe.plans.rules import response_rule
from weblathe.sources import http as web_source
from weblathe.sources import seeds as S
from weblathe.sources import state
from weblathe.streaming.crawl_stream import crawl_stream

RESPONSES = "url string, status int, headers map<string,string>, content binary, redirects array<string>, error string"
LINKS = "from_url string, n int, absolute string, inline boolean, tag string, do_not_follow boolean, source string"
E = "http://example.org/"


def web(spark, links, status=None, moved=None):
    """links: page -> what it links to, a str or (str, inline, do_not_follow)."""
    names = set(links) | {x if isinstance(x, str) else x[0] for v in links.values() for x in v} | set(moved or {}) | set((moved or {}).values())
    r = [(E + n, (status or {}).get(n, 200), {}, b"x", [E + moved[n]] if n in (moved or {}) else [], None) for n in sorted(names)]
    rows = []
    for page, found in links.items():
        for i, x in enumerate(found):
            name, inline, no = (x, False, False) if isinstance(x, str) else x
            rows.append((E + page, i, E + name, inline, "a.href", no, None))
    return spark.createDataFrame(r, RESPONSES), spark.createDataFrame(rows, LINKS)


def saved(done):
    return sorted(r["url"].removeprefix(E) for r in done.saved.collect())


def test_loops_and_self_links(spark):
    r, links = web(spark, {"": ["", "a"], "a": ["", "a", "b"], "b": []})
    done = Crawl(r, links, ["+"]).run(seeds(spark, [E]))
    assert saved(done) == ["", "a", "b"]
    first = done.log.filter("depth = 0").first()
    assert (first["links_total"], first["links_followed"]) == (2, 1)


def test_unsaved_pages_are_visited_again(spark):
    r, links = web(spark, {"": ["a", "b"], "a": ["x"], "b": ["x"], "x": []})
    done = Crawl(r, links, ["+"], ["+", "-path=/x"]).run(seeds(spark, [E]))
    assert done.log.filter("url LIKE '%/x' AND status = 'success'").count() == 2
    assert saved(done) == ["", "a", "b"]


def test_endless_crawl_is_an_error(spark):
    r, links = web(spark, {"": ["a"], "a": [""]})
    with pytest.raises(CrawlError):
        Crawl(r, links, ["+"], ["-"]).run(seeds(spark, [E]))
    with pytest.raises(CrawlError):
        Crawl(r, links, ["+"], ["-"], max_waves=1).run(seeds(spark, [E]))
    assert Crawl(r, links, ["+depth<=5"], ["-"]).run(seeds(spark, [E])).waves == 7  # a limit of depth is an end


def test_long_chains_have_no_limit(spark):
    r, links = web(spark, {f"p{i}": [f"p{i + 1}"] for i in range(30)} | {"": ["p0"]})
    assert len(saved(Crawl(r, links, ["+"]).run(seeds(spark, [E])))) == 32


def in_order(crawl, *args):
    """A crawl's rows; orders by themselves say nothing."""
    done = crawl.run(*args)
    log = [{k: v for k, v in x.asDict(True).items() if k != "order"} for x in done.log.orderBy("depth", "order").collect()]
    places = {(x["depth"], x["order"]): i for i, x in enumerate(done.log.orderBy("depth", "order").collect())}
    expanded = sorted((places[x["p_depth"], x["p_order"]], x["n"], x["url"], x["queued"], x["p_domain_depth"], x["p_original"], str(x["p_root"])) for x in crawl.expanded.collect())
    return done.waves, log, expanded, sorted((x["url"], places.get((x["depth"], x["order"]))) for x in done.known.collect())


REQUISITES = ["-", "+depth<=1", "+requisite"]


@pytest.mark.parametrize("seed", range(3))
def test_chains_have_the_rows_of_waves(spark, monkeypatch, seed):
    """Chains that meet, meet known pages, change hosts, end in errors and close circles."""
    at = random.Random(seed)
    pages = [f"http://{at.choice('ab')}.org/{i}" for i in range(40)]
    rows = [(p, n, at.choice(pages) + at.choice(["", "#x"]), False, "a.href", at.random() < 0.1, None) for p in pages for n in (0, 3)]
    for i, p in enumerate(pages):
        to = at.choice(pages) if at.random() < 0.2 else pages[(i + 1) % 40]
        rows += [(p, n, to, True, "img.src", False, None) for n in (at.choice([1, 4]), 5)]
    rows += [(pages[0], 10 + n, x, False, "a.href", False, None) for n, x in enumerate(at.sample(pages, 5))]
    r = spark.createDataFrame([(p, 404 if at.random() < 0.04 else 200, {}, b"x", [], None) for p in pages[:38]], RESPONSES)
    links = spark.createDataFrame(rows, LINKS)
    start, known = seeds(spark, [pages[0], pages[1]]), spark.createDataFrame([(pages[2],)], "url string")
    used, whole = [], Crawl._chained
    monkeypatch.setattr(Crawl, "_chained", lambda self, *a: used.append(whole(self, *a)) or used[-1])
    if seed == 1:  # orders are ranked where they would grow too large
        monkeypatch.setattr(crawl_module, "MOST", 40)
    got = in_order(Crawl(r, links, REQUISITES), start, known)
    assert used and all(x is not None for x in used)
    monkeypatch.setattr(Crawl, "_settled", lambda self: None)
    assert got == in_order(Crawl(r, links, REQUISITES), start, known)


def test_a_long_chain_takes_few_jobs(spark):
    r, links = web(spark, {f"p{i}": [(f"p{i + 1}", True, False), "p7"] for i in range(150)} | {"": ["p0"]})
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("chain", "a chain")
    done = Crawl(r, links, REQUISITES).run(seeds(spark, [E]))
    depths = {x["url"].removeprefix(E): x["depth"] for x in done.saved.collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert depths == {"": 0} | {f"p{i}": i + 1 for i in range(151)} and done.waves == 152
    assert jobs < 250  # in waves they are more than ten for each page


def test_branches_and_unsaved_pages_go_in_waves(spark, monkeypatch):
    """What isn't a chain isn't taken for one: two requisites of a page, pages that aren't saved, pages that end the way, hosts' depths."""
    monkeypatch.setattr(Crawl, "_chained", lambda self, *a, whole=Crawl._chained: whole(self, *a) and pytest.fail("no chain"))
    chain = {"": ["a"], "a": [("b", True, False)], "b": [("c", True, False)], "c": [("d", True, False)], "d": []}
    start = seeds(spark, [E])
    two = chain | {"c": [("d", True, False), ("e", True, False)], "e": []}
    assert saved(Crawl(*web(spark, two), REQUISITES).run(start)) == ["", "a", "b", "c", "d", "e"]
    assert saved(Crawl(*web(spark, chain), REQUISITES, ["+", "-path=/d"]).run(start)) == ["", "a", "b", "c"]
    assert saved(Crawl(*web(spark, chain), REQUISITES, stop=["-", "+path=/c"]).run(start)) == ["", "a", "b", "c"]
    assert saved(Crawl(*web(spark, chain), [*REQUISITES, "-domain-depth>2"]).run(start)) == ["", "a", "b"]


def test_response_rules_and_many_links_to_a_url(spark):
    """A rule about responses is decided once a url; the first of many links to it is the one that is saved."""
    r, links = web(spark, {"": ["a", "b", "big"], "a": ["big", "small"], "b": ["small", "big", ""]})
    r = r.withColumn("headers", F.create_map(F.lit("content-length"), F.when(F.col("url").endswith("big"), "9000").otherwise("10")))
    done = Crawl(r, links, ["+", "-size>5k"], ["+", "-size<5"]).run(seeds(spark, [E]))
    assert saved(done) == ["", "a", "b", "small"]
    got = {(x["url"].removeprefix(E), x["prev"]["url"].removeprefix(E)): x["status"] for x in done.log.filter("depth > 0").collect()}
    assert got[("big", "")] == got[("big", "a")] == got[("big", "b")] == "rule-deny" and got[("small", "a")] == "success" and got[("small", "b")] == "duplicate"


INFO = "url string, etag string, last_modified string, expires timestamp_ntz, links array<struct<url:string,inline:boolean,tag:string,do_not_follow:boolean,source:string>>"


def test_pages_that_have_not_changed_expand_stored_links(spark):
    """A 304 and a page that isn't asked for lead to what the previous run found in them."""
    r, links = web(spark, {"": ["kept", "fresh"], "kept": ["new"], "fresh": ["new2"], "old": ["x"]})
    r = r.withColumn("headers", F.create_map(F.lit("etag"), F.concat(F.lit("e"), F.length("url").cast("string"))))
    link = lambda n: (E + n, False, "a.href", False, None)
    day = datetime.datetime
    info = [(E + "kept", f"e{len(E + 'kept')}", None, day(2030, 1, 1), [link("old")]), (E + "fresh", "other", None, day(2030, 1, 1), [link("older")]), (E + "old", None, None, day(2031, 1, 1), [link("stored")])]
    df = spark.createDataFrame(info, INFO)
    status = lambda **k: {x["url"].removeprefix(E): x["status"] for x in Crawl(r, links, ["+"], url_info=df, **k).run(seeds(spark, [E])).log.collect()}
    assert status() == {"": "success", "kept": "not-modified", "fresh": "success", "old": "success", "new2": "success", "x": "success"}
    skip = mirror.skipped(False, True, "2030-06-01 00:00:00", F.col("old.expires"))
    assert status(skip=skip) == {"": "success", "kept": "not-modified", "fresh": "success", "old": "not-expired", "new2": "success", "stored": "connect-error"}


def test_columns_and_functions_as_rules(spark):
    """Rules that aren't texts, of links and of responses, among those that are; and what is told of each wave."""
    r, links = web(spark, {"": ["a", "b", "big"], "a": ["c"]})
    r = r.withColumn("headers", F.create_map(F.lit("kind"), F.when(F.col("url").endswith("big"), "large").otherwise("small")))
    told = []
    large = response_rule(F.try_element_at("headers", F.lit("kind")) == "large", positive=False)
    crawl = Crawl(r, links, ["-", lambda: ~F.col("path").endswith("b"), large], [F.col("depth") < 2], on_wave=lambda n, log, found: told.append((n, log.count(), found.count())))
    done = crawl.run(seeds(spark, [E]))
    assert saved(done) == ["", "a"] and {x["url"].removeprefix(E): x["status"] for x in done.log.collect()} == {"": "success", "a": "success", "b": "rule-deny", "big": "rule-deny", "c": "success"}
    assert told == [(0, 1, 3), (1, 3, 1), (2, 1, 0)]


def test_redirects_are_kept(spark):
    r, links = web(spark, {"": ["old", "older"], "new": ["x"]}, moved={"old": "new", "older": "denied"})
    r = r.withColumn("redirect_code", F.when(F.col("url").endswith("old"), 301))
    done = Crawl(r, links, ["+", "-path=/denied"]).run(seeds(spark, [E]))
    assert sorted(map(tuple, done.redirects.collect())) == [(E + "old", 301, E + "new"), (E + "older", 302, E + "denied")]


def test_errors_forms_and_stops(spark):
    r, links = web(spark, {"": ["gone", ("form", False, True), "a"], "a": ["b"], "gone": ["c"]}, status={"gone": 404})
    done = Crawl(r, links, ["+"], stop=["-", "+path=/a"]).run(seeds(spark, [E]))
    status = {x["url"].removeprefix(E): x["status"] for x in done.log.collect()}
    assert status == {"": "success", "gone": "http-error", "form": "no-download", "a": "success"}


def test_redirects(spark):
    r, links = web(spark, {"": ["old", "new"], "new": ["x"]}, moved={"old": "new"})
    done = Crawl(r, links, ["+"]).run(seeds(spark, [E]))
    assert saved(done) == ["", "new", "x"]
    known = {x["url"].removeprefix(E) for x in done.known.collect()}
    assert known == {"", "old", "new", "x"}
    assert done.log.filter("status = 'duplicate'").count() == 1


def test_requisites(spark):
    r, links = web(spark, {"": [("s.css", True, False), "a"]})
    assert saved(Crawl(r, links).run(seeds(spark, [E]))) == ["", "s.css"]
    assert saved(Crawl(r, links, save=["-"], max_waves=5).run(seeds(spark, [E]))) == []


def test_known_urls_of_an_earlier_run(spark):
    r, links = web(spark, {"": ["a"], "a": []})
    first = Crawl(r, links, ["+"]).run(seeds(spark, [E]))
    again = Crawl(r, links, ["+"]).run(seeds(spark, [E]), first.known)
    assert [x["status"] for x in again.log.collect()] == ["duplicate"]


def test_orders_are_ranked_anew(spark, monkeypatch):
    """The same links are processed, saved and counted, in the same order, whether orders are products or ranks."""
    r = random.Random(7)
    graph = {f"p{i}": [f"p{r.randrange(40)}" for _ in range(r.randint(0, 4))] for i in range(40)} | {"": ["p0", "p1", "p2"]}
    pages, links = web(spark, graph)
    got = []
    for most in (1 << 62, 1):
        monkeypatch.setattr(crawl_module, "MOST", most)
        log = Crawl(pages, links, ["+"]).run(seeds(spark, [E])).log
        rows = log.orderBy("depth", "order").select("depth", "order", "url", "prev.url", "status", "saved", "links_total", "links_followed").collect()
        got.append([tuple(x)[:1] + tuple(x)[2:] for x in rows])
        assert all(isinstance(x["order"], int) for x in rows)
    assert got[0] == got[1] and max(x[0] for x in got[0]) > 2
    ranks = crawl_module.ranked(spark.createDataFrame([(x * x,) for x in range(500)] * 2, "order long").repartition(5)).collect()
    assert sorted((x["order"], x["rank"]) for x in ranks) == [(x * x, x) for x in range(500)]


def test_known_urls_in_buckets(spark, tmp_path):
    """The same crawl, with what an earlier one knew; a wave's links meet the table without its being shuffled, however many waves have written to it."""
    r = random.Random(9)
    pages, links = web(spark, {f"p{i}": [f"p{r.randrange(30)}" for _ in range(3)] for i in range(30)} | {"": ["p0", "p1"]})
    earlier = spark.createDataFrame([(E + "p3", 0, 0)], "url string, depth int, `order` bigint")
    got = []
    for buckets in (None, 5):
        done = Crawl(pages, links, ["+"], buckets=buckets).run(seeds(spark, [E]), earlier)
        got.append([sorted(map(repr, map(tuple, x.collect()))) for x in (done.log.select("depth", "order", "url", "status", "saved", "links_total", "links_followed"), done.known)])
    assert got[0] == got[1] and any("p3" in x for x in got[1][1])
    table = Known(spark, str(tmp_path), earlier, 5)
    for wave in range(3):
        table.add(spark.createDataFrame([(f"u{wave}-{i}", True, wave, i) for i in range(50)], "url string, own boolean, depth int, `order` bigint"), wave)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wave = spark.createDataFrame([(f"u{i % 3}-{i}",) for i in range(60)], "url string")
        met = wave.join(table.rows().select("url").distinct().withColumn("is_known", F.lit(True)), "url", "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the wave's links
        assert met.filter("is_known").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_posting_lists(spark):
    """A url that every page links to lies in lists of bounded size that go on from each other; all users are there once, in order."""
    rows = [("hot", f"p{i:04}") for i in range(1003)] * 2 + [(f"u{i}", f"p{i % 7}") for i in range(200)] + [("two", "a"), ("two", "b")]
    got = mirror.usage_pages(spark.createDataFrame(rows, "url string, used_by string").repartition(6), 100).collect()
    want = {}
    for u, p in sorted(set(rows)):
        want.setdefault(u, []).append(p)
    for u, users in want.items():
        lists = sorted((x for x in got if x["url"] == u), key=lambda x: x["page"])
        assert [p for x in lists for p in x["used_by"]] == users and all(len(x["used_by"]) <= 100 for x in lists)
        assert [x["next"] for x in lists] == [*range(1, len(lists)), None]


def test_a_large_host_is_shared_out(spark):
    """A host of many urls is dealt to several tasks, which together keep its rate; small hosts stay whole."""
    rows = [(f"http://large.test/{i}",) for i in range(2000)] + [(f"http://small{i % 5}.test/{i}",) for i in range(50)]
    got = web_source.shared_out(spark.createDataFrame(rows, "url string"), 300).groupBy("host", "share", "shares").count().collect()
    large = [x for x in got if x["host"] == "large.test"]
    assert len(large) == 7 and {x["shares"] for x in large} == {7} and max(x["count"] for x in large) < 400
    assert sorted((x["host"], x["share"], x["shares"], x["count"]) for x in got if x["host"] != "large.test") == [(f"small{i}.test", 0, 1, 10) for i in range(5)]
    now, waited = [0.0], []

    def sleep(seconds):
        waited.append(seconds)
        now[0] += seconds

    pace = web_source.Pace(14.0, lambda: now[0], sleep)
    for _ in range(10):
        pace.wait("large.test", 7)
        pace.wait("small.test", 1)
    assert abs(now[0] - 9 * 0.5) < 1e-9  # one of seven shares of 14 a second is 2 a second
    web_source.Pace(None, lambda: 0.0, lambda s: 1 / 0).wait("large.test", 7)


def test_no_seeds(spark):
    r, links = web(spark, {"": ["a"]})
    assert Crawl(r, links, ["+"]).run(seeds(spark, [])).log.count() == 0


def test_log_lines(spark):
    r, links = web(spark, {"": ["gone", "a"]}, status={"gone": 404})
    got = crawl_log.lines(Crawl(r, links, ["+"]).run(seeds(spark, [E])).log).orderBy("depth", "order").select("line").collect()
    assert [x[0] for x in got] == ["⚑ http://example.org/ +2/2", "404 Not Found http://example.org/gone", "⚑ http://example.org/a"]


def test_filenames(spark):
    """Folders get a name, foreign endings give way to the type's, digests tell queries apart, dots don't lead out."""
    stems = {"/moss": "/moss", "/moss.asp": "/moss", "/moss.htm": "/moss.htm", "/dir/": "/dir/index", "//dir//x/../moss": "/dir//x/__/moss", "/.moss": "/.moss"}
    rows = [(p, q) for p in stems for q in ("", "k=1", "k=2")]
    df = spark.createDataFrame(rows, "p string, q string")
    got = {(r["p"], r["q"]): r["f"] for r in df.select("p", "q", mirror.default_filename(F.lit("garden.test"), F.col("p"), F.col("q"), F.lit("text/html")).alias("f")).collect()}
    for (p, q), f in got.items():
        stem, _, ending = ("garden.test" + stems[p]).partition(".htm") if p.endswith(".htm") else ("garden.test" + stems[p], "", "")
        digest = "_" + hashlib.md5(q.encode()).hexdigest()[:10] if q else ""
        assert f == stem + digest + (".htm" if p.endswith(".htm") else ".html"), (p, q)


def test_seeds_from_text(spark, tmp_path):
    urls = [f"http://garden{i}.test/{'x' * i}" for i in range(5)]
    (tmp_path / "s.txt").write_text("\n \n".join(f"{' ' * i}{u}\t" for i, u in enumerate(urls)) + "\n\n")
    assert sorted(r["raw"] for r in S.from_files(spark, str(tmp_path / "s.txt")).collect()) == urls
    data = {f"name{i}": "v" * i for i in range(1, 4)}
    text = urls[0] + "{" + ",".join(f"{k}={v}" for k, v in data.items()) + "}"
    row = spark.createDataFrame([(text,)], "u string").select(S.user_url(F.col("u")).alias("s")).first()["s"]
    assert (row["target"], row["post"]) == (urls[0], data)
    (tmp_path / "p.html").write_text("<a href=x>")
    local = S.local_files(spark, str(tmp_path / "p.html"), "http://h/").first()
    assert (local["url"], local["headers"]["content-type"], local["is_local"]) == ("http://h/", "text/html", True)


def test_state(spark, tmp_path):
    m = str(tmp_path)
    assert not state.is_mirror(spark, m)
    for part, name in enumerate("ab"):  # a url that is stored under one name, later under another
        state.append(spark.createDataFrame([("u", name, 0)], "url string, filename string, bucket int").select(*[F.col(f.name) if f.name in ("url", "filename", "bucket") else F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema_of("documents")]), m, "documents", part)
    assert state.is_mirror(spark, m) and sorted(r["filename"] for r in state.read(spark, m, "stored").collect()) == ["a", "b"]
    state.write_options(spark, m, {"follow": ["+"]})
    assert state.options(spark, m) == {"follow": ["+"]}


def test_stream(spark, tmp_path):
    r, links = web(spark, {"": ["a"], "a": [("z", False, True)], "z": ["a"]})  # a's link to z isn't followed
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text(E + "\n")
    for i in range(2):
        source = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
        crawl_stream(source, lambda: Crawl(r, links, ["+"]), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
        (tmp_path / "in/2.txt").write_text(E + "z\n")
    known = {x["url"].removeprefix(E): x["batch"] for x in spark.read.parquet(str(tmp_path / "out/known")).collect()}
    assert known == {"": 0, "a": 0, "z": 1}
    changed = {x["url"].removeprefix(E): x["batch"] for x in spark.read.parquet(str(tmp_path / "out/changed")).collect()}
    assert changed == {"a": 1}  # it links to z


def test_bodies_are_read_once_in_a_crawl(spark):
    """However many waves it has; and a rule passes as before where there is no response at all."""
    r, links = web(spark, {"": ["a", "z"], "a": ["b"], "b": ["c"], "c": ["d"], "d": []})
    times = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def body(url):
        times.add(1)
        return b"x"

    r = r.filter(F.col("url") != E + "z").coalesce(1).cache()
    done = Crawl(r.withColumn("content", body("url")), links, ["+", "-content=y", "-size!=1"]).run(seeds(spark, [E]))
    assert saved(done) == ["", "a", "b", "c", "d"]
    assert done.log.filter(F.col("url") == E + "z").first()["status"] == "rule-deny"
    assert times.value <= 2 * r.count()  # once a rule
