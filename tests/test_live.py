"""Mirrors that follow a crawl: bytes as received, files after each wave and batch, backups, expiry."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.test_cli import G, files, page, responses, run
from weblathe import cli
from weblathe.functions import charsets
from weblathe.operators import extract
from weblathe.operators.crawl import Crawl
from weblathe.operators.live import LiveMirror
from weblathe.sources import state
from weblathe.sources.files import compose, write_parts
from weblathe.streaming.crawl_stream import crawl_stream
from weblathe.streaming.expiry import documents_stream, expired

CHARSETS = ["utf-8", "windows-1251", "windows-1252", "iso-8859-1", "shift_jis", "gbk", "gb18030", "big5", "euc-jp", "euc-kr", "iso-2022-jp", "utf-16le", "utf-16be", "koi8-r", "iso-8859-9", "no-such-charset"]


@pytest.mark.parametrize("label", CHARSETS)
def test_places_in_bytes(label):
    """Putting something in place of characters changes their bytes only: the text is the changed text, and nothing else moves; in faulty documents too."""
    r, name = random.Random(1), charsets.codec(label)
    stateful = label == "iso-2022-jp"
    for t in range(300):
        text = "".join(c for c in (r.choice("ab<>\"' \n" + "éяüß漢字かなカ한글中文€“”😀") for _ in range(r.randint(0, 30))) if c.encode(name, "ignore"))
        data = text.encode(name)
        if t % 2 and data and not stateful:  # faulty bytes
            data = bytearray(data)
            for _ in range(r.randint(1, 3)):
                data[r.randrange(len(data))] = r.randrange(256)
            data = bytes(data)
        if t % 5 == 0 and name in charsets._MARKS:
            data = charsets._MARKS[name] + data
        text = charsets.text_of(data, label)
        changes = [(i, i + 1, "XY", False) for i, c in enumerate(text) if c in "ab"]
        assert charsets.spliced(data, label, []) == data
        assert charsets.text_of(charsets.spliced(data, label, changes), label) == text.replace("a", "XY").replace("b", "XY")


def test_faulty_bytes_of_a_charset_with_states_stay():
    data = "漢a字".encode("iso-2022-jp")[:-4] + b"\xe3\x85\x1b"
    assert charsets.spliced(data, "iso-2022-jp", [(1, 2, "XY", False)]) == data


def test_new_text_that_a_charset_lacks():
    assert charsets.bytes_of("a漢", "windows-1251") == "a&#28450;".encode() and charsets.bytes_of("a漢", "windows-1251", True) == rb"a\6f22 "
    assert charsets.bytes_of("a漢", "shift_jis") == "a漢".encode("shift_jis")


SAMPLES = {"windows-1251": "Сад — мох", "shift_jis": "庭の苔―表", "gbk": "苔藓花园", "utf-16le": "мох 苔", "iso-8859-1": "mousse “verte” à 5 €", "euc-kr": "이끼 정원"}


def test_documents_keep_their_bytes(spark, tmp_path):
    """Pages of several charsets, stated or found, come out byte by byte as they were received but for their links; a style sheet and a page with faulty bytes too."""
    pages, want = {}, {}
    for i, (label, words) in enumerate(SAMPLES.items()):
        codec = charsets.codec(label)
        make = lambda a, b: f'<html><head><meta charset={label}></head><title>{words}</title><a title="{words}" {a}>{words}</a>{words}<img src={b} alt="{words}">'.encode(codec)  # noqa: E731, B023
        bom = b"\xff\xfe" if label == "utf-16le" else b""
        headers = {"content-type": f"text/html; charset={label}"} if i % 2 else {}
        pages[f"p{i}"] = page(bom + make("href='/q#x'", "/none.png"), headers)
        want[f"garden.test/p{i}.html"] = bom + make('href="./q.html#x"', '"http://garden.test/none.png"')
    pages["q"] = page(b'<a href=p0>\xff\xfe\x80 caf\xc3</a><a href="p1">\xe9')
    want["garden.test/q.html"] = b'<a href="./p0.html">\xff\xfe\x80 caf\xc3</a><a href="./p1.html">\xe9'
    pages["s.css"] = page('@charset "shift_jis";\n/* 表 */ a{background:url(q)}'.encode("shift_jis"), {"content-type": "text/css"})
    want["garden.test/s.css"] = '@charset "shift_jis";\n/* 表 */ a{background:url("./q.html")}'.encode("shift_jis")
    pages[""] = page("".join(f"<a href={n}>" for n in [*pages]))
    responses(spark, str(tmp_path / "r"), pages)
    run(spark, tmp_path, G, "@follow", "+")
    got = files(tmp_path)
    assert {k: got[k] for k in want} == want
    received = {r["filename"]: bytes(r["content"]) for r in state.read(spark, str(tmp_path / "m"), "documents").collect()}
    assert {k: received[f"garden.test/{k or 'index'}.html"] for k in pages if k != "s.css"} == {k: v[0] if isinstance(v[0], bytes) else v[0].encode() for k, v in pages.items() if k != "s.css"}


def test_extraction_reads_any_charset(spark):
    rows = [(f"{G}{i}", f'<a href="/{words}">'.encode(charsets.codec(label)), {"content-type": f"text/html;charset={label}"}, None) for i, (label, words) in enumerate(SAMPLES.items())]
    df = spark.createDataFrame(rows, "url string, content binary, headers map<string,string>, final_url string")
    got = {r["from_url"]: r["absolute"] for r in extract.links_of(df).collect()}
    assert got == {f"{G}{i}": f"{G}{words}" for i, words in enumerate(SAMPLES.values())}


WEB = {
    "": page('<a href="a">A</a><a href="b">B</a><a href="old">O</a><a href="gone">G</a>'), "a": page('<a href="/">up</a><a href="deep/c#t">C</a><a href=moved>'), "b": page('<a href="a">A</a><img src=p.png>'),
    "deep/c": page("<a href=../b>B</a>"), "old": page("", moved=("deep/c", 301)), "moved": page("", moved=("far", 302)), "far": page("<a href=a>"), "p.png": page(b"\x89PNG\xff", {"content-type": "image/png"}), "lone": page("<a href=far><a href=old>"),
}


def test_files_after_each_wave(spark, tmp_path):
    """While a crawl goes on, links to what isn't there yet lead to the web; they turn local once it is, and the end is that of a run that converts at its end."""
    responses(spark, str(tmp_path / "r"), WEB)
    seen = []
    options = ["-O", str(tmp_path / "m"), "--responses", str(tmp_path / "r")]
    cli.run(spark, cli.parse([*options, G, "@follow", "+"]), "2030-01-01 00:00:00", on_wave=lambda n, log, links: seen.append(files(tmp_path)))
    start = "garden.test/index.html"
    assert seen[0][start] == b'<a href="http://garden.test/a">A</a><a href="http://garden.test/b">B</a><a href="http://garden.test/old">O</a><a href="http://garden.test/gone">G</a>'
    assert seen[1][start] == b'<a href="./a.html">A</a><a href="./b.html">B</a><a href="./deep/c.html">O</a><a href="http://garden.test/gone">G</a>'
    assert seen[0]["index.html"].count(b"<a") == 1 and seen[-1] == files(tmp_path)
    (tmp_path / "x").mkdir()
    responses(spark, str(tmp_path / "x/r"), WEB)
    run(spark, tmp_path / "x", G, "@follow", "+")
    assert files(tmp_path / "x") == files(tmp_path)


def test_backups(spark, tmp_path):
    """Documents that conversion changes are kept as received, each content of a file once."""
    responses(spark, str(tmp_path / "r"), WEB)
    run(spark, tmp_path, G, "--backups", "@follow", "+")
    kept = {k.removeprefix(".backups/garden.test/"): v for k, v in files(tmp_path).items() if k.startswith(".backups/")}
    assert kept == {"index.html": WEB[""][0].encode(), "a.html": WEB["a"][0].encode(), "b.html": WEB["b"][0].encode(), "deep/c.html": WEB["deep/c"][0].encode(), "far.html": WEB["far"][0].encode()}
    responses(spark, str(tmp_path / "r"), WEB | {"a": page("<a href=b>new")})
    run(spark, tmp_path, G, "--update")
    rows = [r["filename"] for r in state.log(spark, str(tmp_path / "m"), "backups").collect()]
    assert sorted(rows) == sorted([f"garden.test/{k}" for k in kept] + ["garden.test/a.html"]) and files(tmp_path)[".backups/garden.test/a.html"] == b"<a href=b>new"


def _stream(spark, tmp_path, name, batches, web, **more):
    """Runs a stream whose batches are lists of seeds; returns the files after each and which earlier pages each changed."""
    responses(spark, str(tmp_path / "web"), web)
    r = spark.read.parquet(str(tmp_path / "web"))
    links = extract.links_of(r)
    into, out = tmp_path / f"{name}-in", tmp_path / name
    into.mkdir()
    got = []
    for i, urls in enumerate(batches):
        (into / f"{i}.txt").write_text("".join(f"{G}{u}\n" for u in urls))
        source = spark.readStream.text(str(into)).withColumnRenamed("value", "raw")
        crawl_stream(source, lambda: Crawl(r, links, ["-", "+path=/deep/*", "+extension=png"]), str(out), str(tmp_path / f"{name}-at"), LiveMirror(spark, str(out / "m"), **more)).awaitTermination(300)
        got.append(files(out))
    changed = {}
    for x in spark.read.parquet(str(out / "changed")).collect():
        changed.setdefault(x["batch"], set()).add(x["url"].removeprefix(G))
    return got, changed


def test_stream_of_a_mirror(spark, tmp_path):
    """After each batch the files are those of one run over all seeds so far; only pages that a batch concerns are written again."""
    batches = [["", "b", "far", "lone"], ["a", "old"], ["moved"]]
    got, changed = _stream(spark, tmp_path, "parts", batches, WEB)
    for k in (len(batches),):
        whole, _ = _stream(spark, tmp_path, f"whole{k}", [[u for b in batches[:k] for u in b]], WEB)
        assert got[k - 1] == whole[0], k
    # a and deep/c concern those that link to them, directly or by old
    assert changed == {1: {"", "b", "far", "lone"}, 2: {"a"}}


def test_compaction(spark, tmp_path):
    """One part of each log, of which everything reads as before; the next part counts as newer."""
    m = str(tmp_path)
    d = lambda url, name, n, part: state.append(spark.createDataFrame([(url, name, f"{n}".encode())], "url string, filename string, content binary").withColumns({c: F.lit(None).cast(state.schema_of("documents")[c].dataType) for c in state.schema_of("documents").names if c not in ("url", "filename", "content", "bucket", "part")}).withColumn("bucket", state.bucket(F.col("url"))), m, "documents", part)
    for part, (url, name, n) in enumerate([("a", "a", 1), ("b", "b", 1), ("a", "a", 2), ("a", "new", 3), ("c", "c", 1)]):
        d(url, name, n, part)
        state.append(spark.createDataFrame([(url, name)], "url string, filename string"), m, "encountered", part)
        state.append(spark.createDataFrame([("r", 301 + part, url)], "url string, code int, target_url string"), m, "redirects", part)
        state.append(spark.createDataFrame([(url, "a")], "url string, used_by string").withColumn("bucket", state.bucket(F.col("url"))), m, "usage", part)
    state.append(spark.createDataFrame([("b", "b"), ("a", "a")], "url string, filename string"), m, "deleted", 5)
    seen = lambda: [sorted(map(repr, state.read(spark, m, v).collect())) for v in ("stored", "url_info", "redirects", "documents")] + [sorted(map(repr, state.log(spark, m, "usage").drop("part").distinct().collect()))]
    before = seen()
    assert len(before[0]) == 2 and "305" in before[2][0] and "b'3'" in "".join(before[3]).replace("bytearray(", "")
    for _ in range(2):
        state.compact(spark, m)
        assert seen() == before and state.next_part(spark, m) - state.first_part(spark, m) == 1 and state._parts(spark, m, "deleted") == []
    d("b", "b", 4, state.next_part(spark, m))
    assert {r["url"]: bytes(r["content"]) for r in state.read(spark, m, "documents").collect()} == {"a": b"3", "b": b"4", "c": b"1"}


def test_index_in_parts(spark, tmp_path):
    """Parts of many ranges are one file in order, also where a range is empty."""
    names = spark.range(5000).select(F.format_string("f%05d", "id").alias("f"))
    ranges = names.repartitionByRange(7, "f").sortWithinPartitions("f").select(F.spark_partition_id().alias("range"), F.concat("f", F.lit("\n")).alias("text"))
    size = compose(write_parts(ranges.filter("range <> 3"), str(tmp_path), "parts"), str(tmp_path), "parts", "all.txt")
    got = (tmp_path / "all.txt").read_text()
    assert len(got) == size and got.split() == sorted(got.split()) and 4000 < len(got.split()) < 5000 and not (tmp_path / "parts").exists()
    assert compose(write_parts(ranges.limit(0), str(tmp_path), "parts"), str(tmp_path), "parts", "none.txt") == 0 and (tmp_path / "none.txt").read_bytes() == b""


def test_expiry_by_a_moving_clock(spark, tmp_path):
    """Each url is due once its last expiry has passed: not before, once, and not at all if it came again without one."""
    at = lambda minutes: datetime.datetime(2030, 1, 1) + datetime.timedelta(minutes=minutes)
    batches = [
        [("a", 10, 0), ("b", 30, 0), ("c", 20, 0), ("d", None, 0)], [(None, None, 5)], [("c", 40, 8)], [(None, None, 15)], [(None, None, 25)], [("b", None, 26), ("a", 27, 26)], [(None, None, 35)], [(None, None, 50)], [("late", 45, 51)], [(None, None, 60)],
    ]
    schema = "url string, expires timestamp, at timestamp"
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, None if e is None else at(e), at(t)) for u, e, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = expired(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        now = sorted(r["raw"] for r in spark.read.schema("raw string, again boolean").parquet(str(tmp_path / "out")).collect())
        got.append(now)
    assert got[2] == [] and got[3] == ["a"] and got[4] == ["a"] and got[6] == ["a", "a"] and got[7] == ["a", "a", "c"] and got[-1] == ["a", "a", "c", "late"]


def test_expired_documents_are_crawled_again(spark, tmp_path):
    """A mirror's own documents are the timers' stream; what is due is a seed that is asked for although it is known."""
    pages = {"": page("<a href=deep/a>"), "deep/a": page("one", {"expires": "Tue, 01 Jan 2030 08:00:00 GMT"})}
    ticks = "at timestamp"
    asked = []
    for i, (hour, pages) in enumerate([(7, pages), (9, pages | {"deep/a": page("two", {"expires": "Tue, 01 Jan 2030 20:00:00 GMT"})}), (10, pages | {"deep/a": page("three")})]):
        now = f"2030-01-01 {hour:02}:00:00"
        responses(spark, str(tmp_path / f"web{i}"), pages)
        r = spark.read.parquet(str(tmp_path / f"web{i}"))
        spark.createDataFrame([(datetime.datetime(2030, 1, 1, hour),)], ticks).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        m = str(tmp_path / "m")
        if i == 0:
            (tmp_path / "in").mkdir()
            spark.createDataFrame([(G, False)], "raw string, again boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "seeds"))
        else:
            clock = spark.readStream.schema(ticks).parquet(str(tmp_path / "ticks"))
            q = expired(documents_stream(spark, m), clock).writeStream.format("parquet").option("path", str(tmp_path / "due")).option("checkpointLocation", str(tmp_path / "due-at")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            due = spark.read.schema("raw string, again boolean").parquet(str(tmp_path / "due")).collect()
            asked.append([x["raw"].removeprefix(G) for x in due])
            if len(due) > len(asked[0]) or i == 1:
                spark.createDataFrame(due[-1:], "raw string, again boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "seeds"))
        source = spark.readStream.schema("raw string, again boolean").parquet(str(tmp_path / "seeds"))
        crawl_stream(source, lambda: Crawl(r, extract.links_of(r), ["-", "+path=/deep/*"]), str(tmp_path / "s"), str(tmp_path / "s-at"), LiveMirror(spark, m), now=lambda: now).awaitTermination(300)
    assert asked == [["deep/a"], ["deep/a"]] and files(tmp_path)["garden.test/deep/a.html"] == b"two"
