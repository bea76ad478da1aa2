"""Command line: seeds and options, then rule lists after @follow, @save and @stop.

From the first @ on, only words that start with @ are options, so that rules may begin with - or --.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions import weburl as U
from weblathe.operators import crawl_log, extract, mirror
from weblathe.operators.crawl import Crawl, Crawled, seeds
from weblathe.operators.live import LiveMirror, received
from weblathe.operators.store import kept
from weblathe.plans.rules import FOLLOW, SAVE, STOP, RuleError, RuleList
from weblathe.sources import http, state
from weblathe.sources.cookies import MODES, Jar
from weblathe.sources.files import compose, write_parts
from weblathe.sources.seeds import from_files, local_files

LISTS = ("follow", "save", "stop")
#: Parts of a mirror's logs after which a run makes one of them.
PARTS = 100
#: The file of a run's log lines.
LOG = ".state/log.txt"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weblathe", description=__doc__)
    p.add_argument("urls", nargs="*")
    p.add_argument("-F", "--from-file", action="append", default=[])
    p.add_argument("-O", "--path", default="mirror")
    p.add_argument("--responses", help="a table of responses to crawl instead of the live web")
    p.add_argument("--layout")
    p.add_argument("--no-link-conversion", action="store_true")
    p.add_argument("--backups", action="store_true")
    p.add_argument("--no-live-update", action="store_true")
    p.add_argument("-U", "--update", action="store_true")
    p.add_argument("--enable-delete", action="store_true")
    p.add_argument("--no-modified-check", action="store_true")
    p.add_argument("--trust-expires", action="store_true")
    p.add_argument("--user-agent", default="firefox")
    p.add_argument("--cookies", choices=MODES, default="persist")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """The options, with lists follow, save and stop; a list that isn't given is the default one."""
    first = next((i for i, x in enumerate(argv) if x.startswith("@")), len(argv))
    out = parser().parse_args(argv[:first])
    for name, default in zip(LISTS, (FOLLOW, SAVE, STOP)):
        setattr(out, name, list(default))
    into = None
    for x in argv[first:]:
        if x.startswith("@"):
            if x[1:] not in LISTS:
                raise RuleError(f"there is no list {x!r}")
            into = []
            setattr(out, x[1:], into)
        else:
            RuleList([x])
            into.append(x)
    out.path = os.path.abspath(out.path) if "://" not in out.path else out.path
    return out


def with_update(options: argparse.Namespace, stored: dict) -> argparse.Namespace:
    """--update repeats the stored options, all but the path."""
    kept = {k: v for k, v in stored.items() if k not in ("path", "update")}
    return argparse.Namespace(**(vars(options) | kept)) if options.update else options


def start_of(spark: SparkSession, options: argparse.Namespace) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Seeds (raw), responses of local files, which are given as path{base url}, and what is to be sent to urls, given as url{name=value,...}."""
    raws, local, posts = [], None, []
    for text in options.urls:
        m = re.fullmatch(r"(?s)(.*?)\{([^}]*)\}", text)
        if m and "://" not in m[1] and "=" not in m[2]:
            files = local_files(spark, m[1], m[2])
            local = files if local is None else local.unionByName(files)
            raws.append(m[2])
        else:
            raws.append(m[1] if m else text)
            if m and "=" in m[2]:
                posts.append((m[1], dict(x.partition("=")[::2] for x in m[2].split(","))))
    start = spark.createDataFrame([(u,) for u in raws], "raw string")
    for f in options.from_file:
        start = start.unionByName(from_files(spark, f))
    if not posts:
        return start, local, None
    return start, local, spark.createDataFrame(posts, "raw string, post map<string,string>").select(U.canonical(U.normalise(F.col("raw"))).alias("url"), "post")


def run(spark: SparkSession, options: argparse.Namespace, now: str | None = None, filename: Callable[[], Column] | None = None, on_wave: Callable[[int, DataFrame, DataFrame], None] | None = None) -> Crawled:
    """Crawls a table of responses, or the live web, and writes the mirror: its tables under .state, its files and their index.

    After each wave the mirror is as if the crawl had ended there, unless no_live_update says to convert links at the end only.
    now: the time of the run in UTC. filename: makes the Column of file names, in place of a layout. on_wave: is told of each wave.
    """
    options = with_update(options, state.options(spark, options.path) if options.update else {})
    now = now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    start, local, posts = start_of(spark, options)
    old = kept(state.read(spark, options.path, "url_info"))
    if state.next_part(spark, options.path) - state.first_part(spark, options.path) > PARTS:
        state.compact(spark, options.path)
    part = state.next_part(spark, options.path)
    out = LiveMirror(spark, options.path, part, not options.no_link_conversion, options.backups)
    name = (lambda mime: filename()) if filename else (lambda mime: mirror.layout(options.layout)) if options.layout else None

    def publish(number: int, log: DataFrame, redirects: DataFrame, update: bool) -> None:
        mine = log.filter("saved")
        if local is not None:  # local files aren't mirrored
            mine = mine.join(local.select("url"), "url", "left_anti")
        files = received(mine.filter("status = 'success'"), crawl.responses, name, now)
        out.publish(number, files, mine.filter("status <> 'success'").select("url"), redirects, update)

    def wave(number: int, log: DataFrame, links: DataFrame) -> None:
        moved = log.filter("status = 'redirect'").groupBy("url").agg(F.max_by(F.struct(F.coalesce("redirect_code", F.lit(302)).alias("code"), "target_url"), "order").alias("r"))
        publish(part + number, log, moved.select("url", "r.*"), True)
        out.write_index()
        if on_wave is not None:
            on_wave(number, log, links)

    asked = {"follow": options.follow, "save": options.save, "stop": options.stop, "url_info": old, "skip": mirror.skipped(options.no_modified_check, options.trust_expires, now, F.col("old.expires"))}
    asked["on_wave"] = on_wave if options.no_live_update else wave
    jar = None
    if options.responses:
        responses = spark.read.parquet(options.responses)
        if local is not None:
            responses = responses.join(local.select("url"), "url", "left_anti").unionByName(local.drop("file", "is_local"), allowMissingColumns=True)
        crawl = Crawl(responses, extract.links_of(responses), **asked)
    else:
        jar = Jar(spark, options.path, options.cookies)
        crawl = Crawl(None, None, fetch=lambda requests: http.fetch(requests, options.user_agent, local=local), links_of=extract.links_of, posts=posts, jar=jar, **asked)
    done = crawl.run(seeds(spark, start))
    if options.no_live_update:
        publish(part, done.log, done.redirects, False)
        out.refresh()
    if options.enable_delete:
        out.prune(part + done.waves)
    if jar is not None:
        jar.save()
    state.write_options(spark, options.path, vars(options))
    if options.no_live_update or options.enable_delete:
        out.write_index()
    return done


def main(argv: list[str] | None = None) -> None:
    options = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("weblathe").getOrCreate()
    done = run(spark, options)
    said = crawl_log.lines(done.log).filter("line IS NOT NULL").orderBy("depth", "order").select(F.concat("line", F.lit("\n")).alias("text"))
    write = said.withColumn("range", F.spark_partition_id())
    compose(write_parts(write.select("range", "text"), options.path, ".state/lines"), options.path, ".state/lines", LOG)
    print(f"{options.path}/{LOG}")
    print(json.dumps(crawl_log.counters(done.log).first().asDict()))


if __name__ == "__main__":
    main()
