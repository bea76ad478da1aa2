"""A crawl as a fixpoint of joins.

The queue of a sequential spider is served in order of depth, so one wave is one depth. Every link has an order, a number
that tells its place among those of its wave: by its page's order, then by its place in the page. Within a wave, the first link of a url that is to be saved decides: links before it and
itself are processed, later ones are duplicates. Nothing else depends on the order, so a wave is: drop what may not
be followed, drop known urls, apply the follow rules that need no response, join what is known of the responses, apply the rest,
replace redirecting links by their targets, drop errors, find the first saving link of each url by an aggregation, and expand.

Responses give only what is asked of them: status, redirects, and whether each rule about a response passes. Of a table of responses this is written
once, before the first wave, so bodies are read once in a crawl, and never go through the joins of links.

Every wave writes its links' fate, the urls that it made known, and what it leads to, before the next one reads them. Known urls are compared with
each wave's links; in buckets, they stay where they are and only the links move. A graph in which no page is saved may have no end: a wave that saves nothing
and meets no new url ends it with an error, unless rules about depth will end it.

Where rules let at most one url of each page be followed, from some depth on, the rest of the crawl goes along chains, and as many waves as the longest has pages
would follow. They are found at once, by doubling pointers (`chains`), and their rows are those that the waves would have had.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weblathe.functions import text as T
from weblathe.functions import weburl as U
from weblathe.operators.chains import first_along
from weblathe.operators.known import Known
from weblathe.operators.mirror import unchanged
from weblathe.operators.store import folder, keep, kept
from weblathe.plans.rules import FOLLOW, SAVE, STOP, TESTS, RuleList, passes

#: Orders are below this; a wave whose links would pass it ranks the pages of the wave before anew.
MOST = 1 << 62
#: Tests of responses that headers are enough for.
HEADERS_ONLY = {"size", "content-type"}
#: Tests that say the same of a link however its page was reached, once its depth is past what rules name; `requisite` does if every page is saved.
FIXED = {
    name: TESTS[name]
    for name in ("", "depth", "same-domain", "path-level", "path-distance", "url", "protocol", "domain", "port", "path", "filename", "extension", "querystring", "fragment", "robots", "tag", "requisite")
}
PARTS = ["url", "scheme", "netloc", "port", "path", "params", "query", "fragment", "is_https"]
#: status of a link in the log, and what becomes of it.
STATUSES = ("no-download", "duplicate", "rule-deny", "connect-error", "redirect-error", "redirect", "http-error", "not-modified", "success", "not-expired")


class CrawlError(RuntimeError):
    pass


@dataclass
class Crawled:
    """log: a row per processed link: order, depth, url, status, saved, links_total, links_followed and the link's columns.
    order counts within a depth. known(url, depth, order): urls that won't be processed again. redirects(url, code, target_url): the last one of each url that had any."""

    log: DataFrame
    known: DataFrame
    waves: int
    redirects: DataFrame | None = None

    @property
    def saved(self) -> DataFrame:
        return self.log.filter("saved")


def with_parts(links: DataFrame, original: str = "original_url") -> DataFrame:
    return links.withColumns(U.link_parts(F.col(original)))


def seeds(spark: SparkSession, urls: list[str] | DataFrame, source: str | None = "user") -> DataFrame:
    """Frontier of wave 0 of a list or a DataFrame (raw). source 'user' exempts seeds from the follow rules."""
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "n int, raw string") if isinstance(urls, list) else urls
    if "n" in rows.columns:
        rows = rows.withColumn("order", 2 * F.col("n").cast("long"))
    else:  # seeds in files have no order of their own: by url, in ranges of urls
        rows = kept(rows.distinct().repartitionByRange("raw").sortWithinPartitions("raw").withColumn("at", F.monotonically_increasing_id()))
        rows = rows.withColumn("order", 2 * F.col("at"))
    here = rows.withColumn("original_url", U.normalise(F.col("raw"))).filter("original_url IS NOT NULL")
    here = with_parts(here)
    return here.select(
        "order", "raw", "original_url", *PARTS, F.lit(0).alias("depth"), F.lit(0).alias("domain_depth"),
        F.lit(None).cast("struct<url:string,original_url:string,netloc:string,path:string>").alias("prev"),
        F.struct("url", "netloc", "path").alias("root"), F.lit(False).alias("inline"), F.lit(None).cast("string").alias("tag"), F.lit(False).alias("do_not_follow"),
        F.lit(source).cast("string").alias("source"), F.lit(None).cast("string").alias("redirect_from"),
    )


@dataclass
class Crawl:
    """responses(url, status, headers, content, redirects, error, and redirect_code if it is known): the web. links(from_url, n, absolute, inline, tag,
    do_not_follow, source): what the extractor found in them. follow, save, stop: rule lists. url_info(url, etag, last_modified, expires, links ...): a
    previous run's pages. Requests for them are conditional, and pages that haven't changed expand their stored links; skip: which of them, as columns
    of old, aren't requested at all."""

    responses: DataFrame | None
    links: DataFrame | None
    follow: RuleList | list[str] = FOLLOW
    save: RuleList | list[str] = SAVE
    stop: RuleList | list[str] = STOP
    max_waves: int | None = None
    max_depth: int | None = None
    url_info: DataFrame | None = None
    skip: Column | None = None
    #: For the live web: requests(url, etag, modified) -> responses, asked for each wave's urls once; and links_of: responses -> links.
    fetch: Callable[[DataFrame], DataFrame] | None = None
    links_of: Callable[[DataFrame], DataFrame] | None = None
    #: (url, post): what is sent with the requests of these urls.
    posts: DataFrame | None = None
    #: map<string,string> over links: headers that the request for a url has, as the first link to it says.
    request_headers: Column | None = None
    #: Buckets of the table of known urls; worth it where many waves meet a table too large to be broadcast.
    buckets: int | None = None
    #: What gives requests their cookies and takes those of responses, wave by wave: has sent(requests) and take(responses).
    jar: object | None = None
    #: What else is to happen after each wave: on_wave(number, log of the wave, links that it leads to).
    on_wave: Callable[[int, DataFrame, DataFrame], None] | None = None

    def __post_init__(self):
        self.follow, self.save, self.stop = (r if isinstance(r, RuleList) else RuleList(list(r)) for r in (self.follow, self.save, self.stop))

    def run(self, start: DataFrame, known: DataFrame | None = None) -> Crawled:
        """known: (url, ...) of an earlier run."""
        spark = start.sparkSession
        self._place = place = f"{folder(spark)}/{uuid.uuid4().hex}"
        before = (known.select("url").distinct() if known is not None else spark.createDataFrame([], "url string")).select("url", F.lit(-1).alias("depth"), F.lit(-1).cast("long").alias("order"))
        self._prepare()
        table = Known(spark, place, before, self.buckets)
        frontier, seen, waves = start, table.rows() if self.buckets else before, 0
        settled, saved, chained = self._settled(), None, None
        while True:
            if self.max_waves is not None and waves >= self.max_waves:
                raise CrawlError(f"not done after {self.max_waves} waves")
            log = written(self._wave(frontier, seen), f"{place}/log", waves)
            own = log.filter("may_save").groupBy("url").agg(F.min(F.struct("order", "depth", "redirect_from")).alias("m"))
            of_source = F.when(F.col("m.redirect_from").isNotNull(), F.struct(F.col("m.redirect_from").alias("url"), F.lit(False).alias("own")))
            urls = F.array_compact(F.array(F.struct("url", F.lit(True).alias("own")), of_source))
            firsts = table.add(own.select(F.explode(urls).alias("u"), "m.depth", "m.order").select("u.url", "u.own", "depth", "order"), waves)
            seen = table.rows()
            decided = self._decided(log, firsts)
            queue = Observation()
            links = self._expand(decided, seen).observe(queue, F.max(F.when(F.col("queued"), F.col("p_order"))).alias("pages"), F.max(F.when(F.col("queued"), F.col("n"))).alias("places"))
            links = written(links, f"{place}/links", waves)
            if self.on_wave is not None:
                self.on_wave(waves, decided, links)
            size = queue.get or links.filter("queued").agg(F.max("p_order").alias("pages"), F.max("n").alias("places")).first()
            if (self.max_depth is not None and waves >= self.max_depth) or size["pages"] is None:
                break
            if settled is not None and waves >= settled:
                pages, saved = saved, firsts.filter("own").count()
                if pages is not None:  # the graph is looked at once, and only if this wave didn't branch
                    chained = self._chained(waves, decided, links.filter("queued"), seen, size["pages"]) if saved <= pages else None
                    settled = None
            if chained is not None:
                break
            frontier = _frontier(links.filter("queued"), size["pages"], size["places"])
            self._progress(log, firsts, waves)
            waves += 1
        log, self.expanded = (waves_of(df, f"{place}/{name}") for df, name in ((log, "log"), (links, "links")))
        firsts = table.waves()
        if chained is not None:
            log, self.expanded, firsts = (x.unionByName(more) for x, more in zip((log, self.expanded, firsts), chained))
            seen, waves = seen.unionByName(chained[2].select("url", "depth", "order")), chained[0].agg(F.max("wave")).first()[0]
        totals = self.expanded.groupBy(F.col("p_depth").alias("depth"), F.col("p_order").alias("order")).agg(F.count(F.lit(1)).alias("links_total"), F.count_if("queued").alias("links_followed"))
        done = self._decided(log, firsts).join(totals, ["depth", "order"], "left").na.fill(0, ["links_total", "links_followed"])
        moved = log.filter("status = 'redirect'").groupBy("url").agg(F.max_by(F.struct(F.coalesce("redirect_code", F.lit(302)).alias("code"), "target_url"), F.struct("depth", "order")).alias("r"))
        first = seen.groupBy("url").agg(F.min(F.struct("depth", "order")).alias("k")).select("url", "k.depth", "k.order")
        return Crawled(done.drop("wave", "redirect_code", "target_url"), first, waves + 1, moved.select("url", "r.code", "r.target_url"))

    def _settled(self) -> float | None:
        """The depth past which rules decide on a link in the same way however its page was reached. None if there is none, or if waves have to come one by one."""
        rules = [r for x in (self.follow, self.save, self.stop) for r in x.rules]
        if self.fetch is not None or self._hops or self.url_info is not None or any(x is not None for x in (self.on_wave, self.max_waves, self.max_depth)):
            return None
        if any(r.test.kind != "R" and FIXED.get(r.test.name) is not r.test for r in rules):
            return None
        return max([0, *(T.number(r.value) or 0 for r in rules if r.test.name == "depth" and r.op)])

    def _ways(self, depth: int) -> DataFrame | None:
        """Of each page, the first link that is followed at this depth and deeper: from_url, n, url, original_url, netloc, path. None if a page has links to several
        urls that are, or if one of them isn't saved or ends the way."""
        of = {"url": F.col("from_url"), "original": F.col("from_url"), "netloc": U.netloc(F.col("from_url")), "path": U.path(F.col("from_url"))}
        root = F.lit(None).cast("struct<url:string,netloc:string,path:string>")
        numbers = {"p_order": F.lit(0).cast("long"), "p_depth": F.lit(depth - 1), "p_domain_depth": F.lit(0), "p_root": root}
        every = _frontier(self._resolved.filter("from_url IS NOT NULL").withColumns({f"p_{k}": v for k, v in of.items()} | numbers), 0, 0)
        fate = self._fate(every.withColumns({"is_known": F.lit(None).cast("boolean"), "prev_encountered": F.lit(True)})).filter(F.col("status").isin(*OPEN))
        link = F.struct((F.col("order") / 2).cast("long").alias("n"), "url", "original_url", "netloc", "path")
        fork = (F.min("url") != F.max("url")) | F.bool_or(~F.col("may_save")) | F.bool_or("stops")
        ways = kept(fate.groupBy(F.col("prev.url").alias("from_url")).agg(F.min(link).alias("l"), fork.alias("fork")).select("from_url", "l.*", "fork"))
        return ways.drop("fork") if ways.filter("fork").isEmpty() else None

    def _chained(self, wave: int, decided: DataFrame, queued: DataFrame, seen: DataFrame, pages: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """What all waves after this one write (log, links, firsts), where the rest of the crawl goes along chains; else None. A page of a chain has the order of the chain's
        first page, on this wave, before its link's place."""
        ways = self._ways(wave + 1)
        if ways is None:
            return None
        width = 2 * (self._resolved.agg(F.max("n")).first()[0] + 1)
        heads = decided.filter("expanded").select("url", F.col("order").alias("r"), "domain_depth", "root")
        if (pages + 1) * width >= MOST:
            ranks = ranked(heads.select(F.col("r").alias("order"))).withColumnRenamed("order", "r")
            heads = heads.join(ranks, "r").withColumn("r", F.col("rank")).drop("rank")
            queued = queued.join(ranks.withColumnRenamed("r", "p_order"), "p_order").withColumn("p_order", F.col("rank")).drop("rank")
        heads = kept(heads)
        ids = kept(ways.select(F.explode(F.array("from_url", "url")).alias("url")).distinct().withColumn("id", F.monotonically_increasing_id()))
        at, to = ids.select(F.col("url").alias("from_url"), F.col("id").alias("at")), ids.withColumnRenamed("id", "to")
        ways = ways.join(seen.select("url").distinct(), "url", "left_anti").join(at, "from_url").join(to, "url")
        ways = kept(ways.withColumn("since", F.when(F.col("netloc") != U.netloc(F.col("from_url")), 0)))
        starts = heads.join(at, F.col("url") == F.col("from_url")).select("at", "r", F.col("domain_depth").alias("run"))
        found = first_along(ways.select("at", "to", "since"), starts).filter("t > 0").drop("at")
        order, depth = (F.col("r") * width + 2 * F.col("n")).alias("order"), (F.col("t") + wave).cast("int").alias("depth")
        met = found.join(ways.withColumnRenamed("at", "via").drop("to", "since"), "via").join(heads.select("r", "root"), "r")
        met = kept(met.select("url", "original_url", "netloc", "path", order, depth, F.col("run").alias("domain_depth"), "root", F.lit("success").alias("status"), F.lit(True).alias("expanded")))
        firsts = met.select("url", F.lit(True).alias("own"), "depth", "order", F.col("depth").alias("wave"))
        known = seen.unionByName(firsts.select("url", "depth", "order"))
        links = kept(self._expand(met, known).withColumn("wave", F.col("p_depth")))
        later = links.filter("queued").withColumn("p_order", F.expr(f"p_order DIV {width}"))
        frontier = _frontier(queued.unionByName(later), 0, width // 2 - 1)
        before = known.select("url", F.col("depth").alias("k_depth"))
        f = frontier.join(before, "url", "left").withColumns({"is_known": F.when(F.col("k_depth") < F.col("depth"), True), "prev_encountered": F.lit(True)}).drop("k_depth")
        return kept(self._fate(f).withColumn("wave", F.col("depth"))), links, firsts

    def _prepare(self) -> None:
        self._asked_for = 0  # tables of responses so far
        about = {r.test.name for r in self.follow.rules if r.test.kind == "R"}
        self._heads = self.fetch is not None and bool(about) and about <= HEADERS_ONLY
        if self.fetch is not None:
            self._hops = True
        elif self.url_info is not None and {"etag", "last_modified"} <= set(self.url_info.columns):
            self.responses = unchanged(self.url_info, self.responses)
        if self.fetch is None:
            self.responses = _coded(self.responses)
        links = [self.links.withColumn("stored", F.lit(False))] if self.links is not None else []
        if self.url_info is not None and "links" in self.url_info.columns:
            old = self.url_info.select(F.col("url").alias("from_url"), F.posexplode("links").alias("n", "l"))
            links.append(old.select("from_url", "n", F.col("l.url").alias("absolute"), "l.inline", "l.tag", "l.do_not_follow", "l.source", F.lit(True).alias("stored")))
        self._resolved = None
        for x in links:
            self._resolve(x)
        rules = {r.source: r for x in (self.follow, self.save, self.stop) for r in x.rules if r.test.kind == "R"}
        self._asked = {source: (f"passes_{i}", rule) for i, (source, rule) in enumerate(rules.items())}
        self._given = {source: F.coalesce(F.col(name), F.lit(False)) for source, (name, _) in self._asked.items()}
        self._passed = [passes(rule).alias(name) for name, rule in self._asked.values()]
        if self.fetch is None:
            self._answer()
        # Columns that every wave uses are made once: making them takes longer than a small wave's jobs.
        user = F.coalesce(F.col("source") == "user", F.lit(False))
        self._denied = ~(user | (self.follow.column(F.coalesce("hops", F.lit(False)), self._given) if "R" in self.follow.kinds else self.follow.column()))
        self._target_denied = ~(user | self.follow.column(None, self._given)) if self._hops else None
        self._saves, self._stops = self.save.column(None, self._given), self.stop.column(None, self._given)
        self._target = U.canonical(F.col("last_url")) if self._hops else F.lit(None).cast("string")

    def _answer(self) -> None:
        """What decisions need of all responses of a table; and how rules pass where there is no response."""
        self._answers = kept(self.responses.select("url", *self._said()))
        self._hops = not self._answers.filter("hops").isEmpty()
        self._absent = {}
        if self._passed:
            nothing = self._answers.sparkSession.createDataFrame([(None,) * len(self.responses.columns)], StructType([StructField(f.name, f.dataType) for f in self.responses.schema]))
            self._absent = nothing.select(*self._passed).first().asDict()

    def _said(self) -> list:
        last = U.normalise(F.try_element_at("redirects", F.lit(-1))) if self.fetch is None or self._hops else F.lit(None).cast("string")
        return ["status", "error", "redirect_code", F.coalesce(F.size("redirects") > 0, F.lit(False)).alias("hops"), last.alias("last_url"), *self._passed]

    def _resolve(self, links: DataFrame) -> None:
        new = kept(with_parts(links.withColumn("original_url", U.normalise(F.col("absolute"))).filter("original_url IS NOT NULL")))
        self._resolved = new if self._resolved is None else self._resolved.unionByName(new)

    def _to_ask(self, links: DataFrame) -> DataFrame:
        """The distinct urls of links; on the live web, each with the page that its first link is on, and that link's headers."""
        if self.fetch is None:
            return links.select("url").distinct()
        own = [F.col("prev.original_url").alias("referer")] + ([self.request_headers.alias("extra")] if self.request_headers is not None else [])
        return links.groupBy("url").agg(F.min_by(F.struct(*own), "order").alias("r")).select("url", "r.*")

    def _responses_of(self, urls: DataFrame, head: bool = False) -> DataFrame:
        """From the web: what comes from there is written before anything else reads it, so nothing is asked for twice. head: headers only."""
        asked = urls.columns
        if self.url_info is not None:
            old = self.url_info.select(F.col("url").alias("old_url"), "etag", F.col("last_modified").alias("modified"), F.struct(*[c for c in self.url_info.columns if c != "links"]).alias("old"))
            urls = urls.join(old, F.col("url") == F.col("old_url"), "left")
            if self.skip is not None:
                urls = urls.filter(~F.coalesce(F.col("old").isNotNull() & self.skip, F.lit(False)))
            urls = urls.select(*asked, "etag", "modified")
        if head:
            urls = urls.withColumn("method", F.lit("HEAD"))
        elif self.posts is not None:
            urls = urls.join(self.posts.select("url", "post"), "url", "left")
        if self.jar is not None:
            urls = self.jar.sent(urls)
        spark, part = urls.sparkSession, f"{self._place}/{'heads' if head else 'responses'}/part={self._asked_for}"
        keep(_coded(self.fetch(urls)), part)
        self._asked_for += 1
        new = spark.read.parquet(part)
        if self.jar is not None:
            self.jar.take(new)
        if head:
            return new
        self.responses = spark.read.parquet(f"{self._place}/responses").drop("part")
        self._resolve(self.links_of(new.filter(F.col("status") < 300)).withColumn("stored", F.lit(False)))
        return new

    def _progress(self, log: DataFrame, firsts: DataFrame, wave: int) -> None:
        if wave == 0 or any(r.test.name in ("depth", "domain-depth") for r in self.follow.rules) or not firsts.isEmpty():
            return
        earlier = waves_of(log, f"{self._place}/log").filter(F.col("wave") < wave).select("url").distinct()
        if log.select("url").distinct().join(earlier, "url", "left_anti").isEmpty():
            raise CrawlError("pages that aren't saved are never known, and these lead to each other without end")

    def _facts(self, urls: DataFrame, head: bool = False) -> DataFrame:
        """Of distinct urls: what their responses, and the previous run, say that a decision needs."""
        if self.fetch is not None:
            r = self._responses_of(urls, head).withColumnRenamed("url", "response_url")
            got = urls.select("url").join(r, F.col("url") == F.col("response_url"), "left").select("url", *self._said())
        elif not self._asked and self.skip is None:  # links meet the table as it is
            got = self._answers
        else:
            got = urls.select("url").join(self._answers.withColumnRenamed("url", "response_url"), F.col("url") == F.col("response_url"), "left").drop("response_url")
            got = got.withColumns({"hops": F.coalesce("hops", F.lit(False))} | {name: F.coalesce(name, F.lit(x)) for name, x in self._absent.items()})
        if self.url_info is not None and self.skip is not None:
            names = [c for c in self.url_info.columns if c not in ("url", "links")]
            old = self.url_info.select(F.col("url").alias("old_url"), F.struct(*names).alias("old"))
            got = got.join(old, F.col("url") == F.col("old_url"), "left").withColumn("unasked", F.coalesce(F.col("old").isNotNull() & self.skip, F.lit(False))).drop("old", "old_url")
        else:
            got = got.withColumn("unasked", F.lit(False))
        return got.withColumnRenamed("url", "fact_url")

    def _wave(self, frontier: DataFrame, known: DataFrame) -> DataFrame:
        known = known.select("url").distinct() if self._hops else known.select("url")  # a url is there twice only if redirects lead to it too
        f = frontier.join(known.withColumn("is_known", F.lit(True)), "url", "left")
        if "M" in self.follow.kinds | self.save.kinds | self.stop.kinds:
            before = known.select(F.col("url").alias("prev_url"), F.lit(True).alias("prev_encountered"))
            f = f.join(before, F.col("prev.url") == F.col("prev_url"), "left").drop("prev_url")
            f = f.withColumn("prev_encountered", F.coalesce("prev_encountered", F.lit(False)))
        else:
            f = f.withColumn("prev_encountered", F.lit(False))
        return self._fate(f, known)

    def _fate(self, f: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """What becomes of links, of which is_known and prev_encountered are told. known: only asked where responses redirect."""
        early = F.when(F.col("do_not_follow"), "no-download").when(F.col("is_known"), "duplicate")
        if "R" not in self.follow.kinds:  # decided before anything is requested
            early = F.coalesce(early, F.when(self._denied, "rule-deny"))
        f = f.withColumn("status_text", early)
        pending = f.filter("status_text IS NULL")
        if self._heads:  # only what the headers let through is asked for in full; an error stands, and what the user gave needs no leave
            heads = self._facts(self._to_ask(pending.filter("source IS DISTINCT FROM 'user'")), True)
            told = pending.join(heads, F.col("url") == F.col("fact_url"), "left")
            failed = (F.col("status") >= 400) | F.col("error").isNotNull() | F.col("unasked")
            full = self._facts(self._to_ask(told.filter(~self._denied & ~F.coalesce(failed, F.lit(False)))))
            facts = kept(full.unionByName(heads.join(full.select("fact_url"), "fact_url", "left_anti")))
        else:
            facts = self._facts(self._to_ask(pending))
        f = f.join(facts, (F.col("url") == F.col("fact_url")) & F.col("status_text").isNull(), "left")
        if "R" in self.follow.kinds:
            f = f.withColumn("status_text", F.coalesce("status_text", F.when(self._denied, "rule-deny")))
        state = F.when(F.col("unasked"), "not-expired").when(F.col("error").eqNullSafe("redirect"), "redirect-error").when(F.col("hops"), "redirect")
        f = f.withColumn("status_text", F.coalesce("status_text", state))
        if not self._hops:
            return self._judged(f)
        f = kept(f)
        sources = f.filter("status_text = 'redirect'")
        targets = self._targets(sources, known)
        both = f.filter("status_text IS NULL OR status_text <> 'redirect'").unionByName(targets, allowMissingColumns=True)
        return self._judged(both).unionByName(self._judged(sources))

    def _targets(self, sources: DataFrame, known: DataFrame) -> DataFrame:
        """The target links of redirecting ones, which come directly after them and have to be followed in their own right."""
        t = sources.withColumn("redirect_from", F.col("url")).withColumns({"raw": F.col("last_url"), "original_url": F.col("last_url")})
        t = with_parts(t.drop(*PARTS, "is_known", *self._fact_names(), "status_text")).filter("original_url IS NOT NULL")
        own = F.struct("url", "netloc", "path")  # the target of a seed is its own root
        t = t.withColumn("order", F.col("order") + 1).withColumn("root", F.when(F.col("prev").isNull(), own).otherwise(F.col("root")))
        t = t.join(known.select("url").withColumn("is_known", F.lit(True)), "url", "left")
        facts = self._facts(self._to_ask(t.filter("is_known IS NULL")))
        t = t.join(facts, F.col("url") == F.col("fact_url"), "left")
        state = F.when(F.col("is_known"), "duplicate").when(self._target_denied, "rule-deny").when(F.col("hops"), "redirect-error")
        return t.withColumn("status_text", state)

    def _fact_names(self) -> list[str]:
        return ["fact_url", "status", "error", "redirect_code", "hops", "last_url", "unasked", *(name for name, _ in self._asked.values())]

    def _judged(self, f: DataFrame) -> DataFrame:
        """The log's columns before it is known which link of a url comes first."""
        missing = F.col("status").isNull() | F.coalesce(F.col("error") == "connect", F.lit(False))
        state = F.when(missing, "connect-error").when(F.col("status") >= 400, "http-error").when(F.col("status") == 304, "not-modified").otherwise("success")
        f = f.withColumn("status_text", F.coalesce("status_text", state))
        ok, unconditional = F.col("status_text").isin(*OPEN), F.col("status_text").isin("not-modified", "not-expired")
        out = ["order", "depth", "domain_depth", "raw", "original_url", *PARTS, "prev", "root", "inline", "tag", "do_not_follow", "source", "redirect_from"]
        return f.select(
            *out, F.col("status_text").alias("status"), F.col("status").cast("int").alias("code"), "redirect_code", self._target.alias("target_url"),
            F.when(ok, unconditional | self._saves).otherwise(False).alias("may_save"), F.when(ok, self._stops).otherwise(False).alias("stops"),
        )

    @staticmethod
    def _decided(log: DataFrame, firsts: DataFrame) -> DataFrame:
        """log with the final status, saved, bail and expanded."""
        first = firsts.filter("own").select(F.col("url").alias("f_url"), F.col("wave").alias("f_wave"), F.col("order").alias("first_saved"))
        f = log.join(first, (F.col("url") == F.col("f_url")) & (F.col("wave") == F.col("f_wave")), "left")
        ok = F.col("status").isin(*OPEN)
        late = ok & F.col("first_saved").isNotNull() & (F.col("order") > F.col("first_saved"))
        f = f.withColumn("saved", F.col("may_save") & F.col("order").eqNullSafe(F.col("first_saved"))).withColumn("bail", ok & ~late & F.col("stops")).withColumn("expanded", ok & ~late & ~F.col("stops"))
        return f.withColumn("status", F.when(late, "duplicate").otherwise(F.col("status"))).drop("f_url", "f_wave", "first_saved", "may_save", "stops")

    def _expand(self, done: DataFrame, known: DataFrame) -> DataFrame:
        """The links of expanded pages, stored ones of pages that weren't loaded; queued: those whose url wasn't known when the page was expanded."""
        stored = F.col("status").isin("not-modified", "not-expired") & F.lit(self.url_info is not None and "links" in self.url_info.columns)
        parent = done.filter("expanded").select(
            F.col("url").alias("p_url"), F.col("original_url").alias("p_original"), F.col("netloc").alias("p_netloc"), F.col("path").alias("p_path"),
            F.col("order").alias("p_order"), F.col("depth").alias("p_depth"), F.col("domain_depth").alias("p_domain_depth"), F.col("root").alias("p_root"), stored.alias("p_stored"),
        )
        links = parent.join(self._resolved, (F.col("p_url") == F.col("from_url")) & (F.col("p_stored") == F.col("stored"))).drop("p_stored", "stored")
        at = F.struct("depth", "order")
        seen = known.groupBy(F.col("url").alias("k_url")).agg(F.min(at).alias("k")) if self._hops else known.select(F.col("url").alias("k_url"), at.alias("k"))
        links = links.join(seen, F.col("url") == F.col("k_url"), "left")
        earlier = F.col("k_url").isNotNull() & (F.col("k") <= F.struct(F.col("p_depth").alias("depth"), F.col("p_order").alias("order")))
        return links.withColumn("queued", ~earlier).drop("k_url", "k")


def _coded(responses: DataFrame) -> DataFrame:
    return responses if "redirect_code" in responses.columns else responses.withColumn("redirect_code", F.lit(None).cast("int"))


OPEN = ("success", "not-modified", "not-expired")


def written(df: DataFrame, place: str, wave: int) -> DataFrame:
    """df, written as a wave of a table."""
    path = f"{place}/wave={wave}"
    keep(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path).withColumn("wave", F.lit(wave))


def waves_of(one: DataFrame, place: str) -> DataFrame:
    """All waves of a table that one is a wave of."""
    return one.sparkSession.read.schema(one.schema).parquet(place)


def ranked(orders: DataFrame) -> DataFrame:
    """order and rank, from 0 without gaps, of orders(order). Ranges of orders are counted, and the driver sees one row a range."""
    parts = kept(orders.distinct().repartitionByRange("order").sortWithinPartitions("order").select("order", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn")))
    ends, shifts = 0, []
    for r in parts.groupBy("part").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        shifts.append((r["part"], ends - r["first"]))
        ends += r["n"]
    shift = orders.sparkSession.createDataFrame(shifts, "part int, shift long")
    return parts.join(shift, "part").select("order", (F.col("turn") + F.col("shift")).alias("rank"))


def _frontier(links: DataFrame, pages: int, places: int) -> DataFrame:
    """The queued links as links of the next wave. pages: the largest order of their pages; places: the largest place. Odd orders are for the targets of redirects."""
    width = 2 * (places + 1)
    if (pages + 1) * width >= MOST:
        ranks = ranked(links.select(F.col("p_order").alias("order")))
        links = links.join(ranks.select(F.col("order").alias("p_order"), "rank"), "p_order").withColumn("p_order", F.col("rank")).drop("rank")
    return links.select(
        (F.col("p_order") * width + 2 * F.col("n")).cast("long").alias("order"), F.col("absolute").alias("raw"), "original_url", *PARTS,
        (F.col("p_depth") + 1).alias("depth"), F.when(F.col("netloc") == F.col("p_netloc"), F.col("p_domain_depth") + 1).otherwise(0).alias("domain_depth"),
        F.struct(F.col("p_url").alias("url"), F.col("p_original").alias("original_url"), F.col("p_netloc").alias("netloc"), F.col("p_path").alias("path")).alias("prev"),
        F.col("p_root").alias("root"), "inline", "tag", "do_not_follow", "source", F.lit(None).cast("string").alias("redirect_from"),
    )
