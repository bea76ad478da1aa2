"""A jar of cookies as keyed state over the waves of a crawl.

A wave's requests meet the jar by the suffixes of their hosts and the prefixes of their paths; a fetching task has nothing but its own requests' cookies. What servers set comes
back as rows with the responses, and the wave's rows are merged into the jar by (domain, path, name): of several of one wave the last by request url, then by place in the
response, counts, whichever task was faster. So all requests of a wave see the jar as the wave before left it.
"""

from __future__ import annotations

import http.cookiejar
import time
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.sources import state

COOKIE = "struct<domain:string,host_only:boolean,path:string,name:string,value:string,secure:boolean,expires:bigint>"
FIELDS = ["domain", "host_only", "path", "name", "value", "secure", "expires"]
KEY = ["domain", "path", "name"]
#: persist: cookies of earlier runs are sent, and new ones are kept; accept: new ones last for the run; refuse: new ones are ignored; block: none are sent or taken.
MODES = ("persist", "accept", "refuse", "block")


def suffixes(host: Column) -> Column:
    """A host and all domains above it, lower-cased: a.b.c, b.c, c."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host(url: Column) -> Column:
    """The host of a url, without user and port."""
    return F.lower(F.regexp_extract(url, r"\A[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_matches(path: Column, prefix: Column) -> Column:
    """Whether a request's path is in a cookie's: the same, or below it at a slash."""
    return (path == prefix) | (path.startswith(prefix) & (prefix.endswith("/") | (F.substr(path, F.char_length(prefix) + 1, F.lit(1)) == "/")))


def sent(requests: DataFrame, jar: DataFrame, now: int) -> DataFrame:
    """requests(url, ...) with cookies: those of the jar that go with each, longer paths first."""
    at = F.regexp_extract("url", r"\A[^:/?#]*://[^/?#]*([^?#]*)", 1)
    rows = requests.select("url", host(F.col("url")).alias("host"), F.when(at == "", "/").otherwise(at).alias("at")).distinct().withColumn("domain", F.explode(suffixes(F.col("host"))))
    live = jar.filter(F.col("expires").isNull() | (F.col("expires") > now))
    fits = (~F.col("host_only") | (F.col("domain") == F.col("host"))) & path_matches(F.col("at"), F.col("path")) & (~F.col("secure") | F.col("url").startswith("https:"))
    found = rows.join(live, "domain").filter(fits).groupBy("url").agg(F.collect_list(F.struct(-F.char_length("path"), *FIELDS)).alias("c"))
    ordered = F.transform(F.sort_array("c"), lambda x: F.struct(*[x[f].alias(f) for f in FIELDS]))
    return requests.join(found.select("url", ordered.alias("cookies")), "url", "left")


def merged(jar: DataFrame, responses: DataFrame, now: int) -> DataFrame:
    """The jar after a wave of responses(url, set_cookies): new cookies replace old ones, and those that have expired go."""
    new = responses.select("url", F.posexplode("set_cookies").alias("n", "c")).select("url", "n", "c.*")
    last = new.groupBy(*KEY).agg(F.max_by(F.struct(*[f for f in FIELDS if f not in KEY]), F.struct("url", "n")).alias("c")).select(*KEY, "c.*")
    return jar.join(last, KEY, "left_anti").select(FIELDS).unionByName(last.select(FIELDS)).filter(F.col("expires").isNull() | (F.col("expires") > now))


class Carried(urllib.request.BaseHandler):
    """Sends and takes the cookies of one request and of the redirects that it leads to."""

    handler_order = 600

    def __init__(self, cookies: list[dict]):
        self.jar = http.cookiejar.CookieJar()
        for c in cookies or []:
            self.jar.set_cookie(_cookie(c))
        self.set_cookies: list[dict] = []  # what the servers have set or taken back, in order

    def http_request(self, request):
        self.jar.add_cookie_header(request)
        return request

    def http_response(self, request, response):
        before = {(c.domain, c.path, c.name): c for c in self.jar}
        made = [c for c in self.jar.make_cookies(response, request) if self.jar._policy.set_ok(c, request)]
        left = {(c.domain, c.path, c.name) for c in self.jar}
        self.set_cookies += [_row(c) | {"expires": 0} for k, c in before.items() if k not in left]  # a server takes a cookie back by letting it expire
        for c in made:
            self.jar.set_cookie(c)
            self.set_cookies.append(_row(c))
        return response

    https_request, https_response = http_request, http_response


def _cookie(c: dict) -> http.cookiejar.Cookie:
    domain = c["domain"] if c["host_only"] else "." + c["domain"]
    if c["host_only"] and "." not in domain:
        domain += ".local"  # as Python's policy names hosts without dots
    return http.cookiejar.Cookie(0, c["name"], c["value"], None, False, domain, not c["host_only"], not c["host_only"], c["path"], True, bool(c["secure"]), c["expires"], c["expires"] is None, None, None, {})


def _row(c: http.cookiejar.Cookie) -> dict:
    domain = c.domain.removesuffix(".local") if c.domain.count(".") == 1 and c.domain.endswith(".local") else c.domain
    return {"domain": domain.lstrip(".").lower(), "host_only": not c.domain.startswith("."), "path": c.path or "/", "name": c.name, "value": c.value, "secure": bool(c.secure), "expires": None if c.expires is None else int(c.expires)}


class Jar:
    """The jar of a run by its mode (MODES), kept in the mirror's state."""

    def __init__(self, spark: SparkSession, mirror: str, mode: str = "persist", now: int | None = None):
        if mode not in MODES:
            raise ValueError(f"there is no mode {mode!r}")
        self.mode, self.mirror, self.now = mode, mirror, int(time.time()) if now is None else now
        self.table = state.read(spark, mirror, "cookies") if mode != "block" else None

    def sent(self, requests: DataFrame) -> DataFrame:
        return requests if self.mode == "block" else sent(requests, self.table, self.now)

    def take(self, responses: DataFrame) -> None:
        """Merges what a wave's responses, which are written already, have set."""
        if self.mode in ("persist", "accept"):
            from weblathe.operators.store import kept

            self.table = kept(merged(self.table, responses, self.now))

    def save(self) -> None:
        if self.mode == "persist":
            state.write(self.table, self.mirror, "cookies")
