"""Responses from the live web: one task fetches the urls of a partition. Static responses are a table instead."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblathe.sources.cookies import COOKIE, Carried

SCHEMA = f"url string, final_url string, status int, headers map<string,string>, content binary, redirects array<string>, error string, redirect_code int, set_cookies array<{COOKIE}>"
NAMES = ["url", "final_url", "status", "headers", "content", "redirects", "error", "redirect_code", "set_cookies"]
ATTEMPTS = 7
#: Names for user agents.
AGENTS = {
    "firefox": "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0",
    "safari": "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.5 Safari/605.1.15",
    "chrome": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36",
    "ie": "Mozilla/5.0 (Windows NT 10.0; WOW64; Trident/7.0; rv:11.0) like Gecko",
}


class _Hops(urllib.request.HTTPRedirectHandler):
    def __init__(self):
        self.seen: list[str] = []
        self.code: int | None = None

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.seen.append(newurl)
        self.code = self.code or code  # that of the first hop
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch_one(url: str, agent: str, referer: str | None = None, etag: str | None = None, modified: str | None = None, post: dict | None = None, cookies: list[dict] | None = None, extra: dict | None = None, method: str | None = None, timeout: float = 30) -> dict:
    """The response of a url; error is 'connect' or 'redirect' where there is none. extra: more headers. cookies: what is sent; set_cookies: what servers set."""
    headers = {k: v for k, v in (("User-Agent", agent), ("Referer", referer), ("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    headers = {k.title(): v for k, v in headers.items()} | {k.title(): v for k, v in (extra or {}).items()}
    out = {"url": url, "final_url": url, "status": None, "headers": {}, "content": None, "redirects": [], "error": "connect", "redirect_code": None, "set_cookies": []}
    for _ in range(ATTEMPTS):
        hops, carried = _Hops(), Carried(cookies)
        opener = urllib.request.build_opener(hops, carried)
        try:
            data = urllib.parse.urlencode(post).encode() if post else None
            with opener.open(urllib.request.Request(url, data, headers, method=method), timeout=timeout) as r:
                return out | {"final_url": r.url, "status": r.status, "headers": {k.lower(): v for k, v in r.headers.items()}, "content": r.read(), "redirects": hops.seen, "error": None, "redirect_code": hops.code, "set_cookies": carried.set_cookies}
        except urllib.error.HTTPError as e:
            loop = e.code in (301, 302, 303, 307, 308)
            return out | {"status": e.code, "headers": {k.lower(): v for k, v in e.headers.items()}, "content": e.read(), "redirects": hops.seen, "error": "redirect" if loop else None, "redirect_code": hops.code, "set_cookies": carried.set_cookies}
        except OSError:
            continue
    return out


def shared_out(requests: DataFrame, per_task: int) -> DataFrame:
    """requests with host, share and shares: a host's urls are dealt to as many shares as it takes for each to have about per_task."""
    rows = requests.withColumn("host", F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1)))
    many = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("shares")).filter("shares > 1")
    rows = rows.join(many, "host", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    return rows.withColumn("share", F.pmod(F.xxhash64("url"), F.col("shares")).cast("int"))


class Pace:
    """Keeps a share of a host's requests apart, so that all shares together stay below its rate."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.due = rate, clock, sleep, {}

    def wait(self, host: str, shares: int) -> None:
        if not self.rate:
            return
        now = self.clock()
        if self.due.get(host, now) > now:
            self.sleep(self.due[host] - now)
            now = self.due[host]
        self.due[host] = now + shares / self.rate


def fetch(requests: DataFrame, agent: str = "firefox", partitions: int = 64, local: DataFrame | None = None, per_task: int = 500, rate: float | None = None) -> DataFrame:
    """Responses of requests (url, and any of referer, etag, modified, post, cookies, extra, method). A host's urls are in one task, or in several if they are more than per_task, which
    share out the host's rate (requests a second; None for as fast as it answers). local: responses of files, which aren't asked for."""
    if local is not None:
        files = local.join(requests.select("url"), "url", "left_semi")
        asked = fetch(requests.join(local.select("url"), "url", "left_anti"), agent, partitions, None, per_task, rate)
        return asked.unionByName(files.drop("file", "is_local"), allowMissingColumns=True)
    name = AGENTS.get(agent, agent)
    columns = [c for c in ("referer", "etag", "modified", "post", "cookies", "extra", "method") if c in requests.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rate)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                pace.wait(row["host"], row["shares"])
                out.append(fetch_one(row["url"], name, **{c: _given(row[c]) for c in columns}))
            yield pd.DataFrame(out, columns=NAMES)

    return shared_out(requests, per_task).repartition(partitions, "host", "share").mapInPandas(run, SCHEMA)


def _given(value):
    """A value of a batch; None for what is missing or empty."""
    if value is None or isinstance(value, float):
        return None
    return list(value) or None if hasattr(value, "__len__") and not isinstance(value, (str, dict)) else value or None
