"""What a crawl asks before it follows, requests, saves and expands, as a class whose methods are overridden.

Methods are called once a crawl and return rules or Columns, so what they say is part of the plan; they aren't called for links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.operators.crawl import Crawl
from weblathe.plans.rules import FOLLOW, SAVE, STOP, RuleList


class Policy:
    def follow(self) -> RuleList | list | Column:
        """Whether a link is followed: a rule list, or a Column over links."""
        return list(FOLLOW)

    def save(self) -> RuleList | list | Column:
        """Whether a page is saved."""
        return list(SAVE)

    def stop(self) -> RuleList | list | Column:
        """Whether the links of a page are left alone, after it was saved."""
        return list(STOP)

    def skip_download(self) -> Column | None:
        """Whether a url of an earlier run isn't requested, over old, what is known of it; its stored links are used."""
        return None

    def configure_session(self) -> dict[str, str]:
        """Headers of all requests."""
        return {}

    def configure_request(self) -> Column | None:
        """Headers of the request for a link, map<string,string> over links; they win over the session's."""
        return None

    def headers(self) -> Column | None:
        """Of session and request together."""
        session, own = {k.lower(): v for k, v in self.configure_session().items()}, self.configure_request()
        if not session:
            return own
        all_ = F.create_map(*[F.lit(x) for pair in session.items() for x in pair])
        if own is None:
            return all_
        own = F.coalesce(F.transform_keys(own, lambda k, v: F.lower(k)), F.create_map().cast("map<string,string>"))
        return F.map_concat(F.map_filter(all_, lambda k, v: ~F.map_contains_key(own, k)), own)

    def crawl(self, responses: DataFrame | None = None, links: DataFrame | None = None, **more) -> Crawl:
        """A crawl by these rules; more: what else Crawl takes."""
        lists = {k: [x] if isinstance(x, Column) else x for k, x in (("follow", self.follow()), ("save", self.save()), ("stop", self.stop()))}
        return Crawl(responses, links, skip=self.skip_download(), request_headers=self.headers(), **lists, **more)
