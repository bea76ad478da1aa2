"""What happens to links, as rows: a row per call that an observer of a sequential crawl would get, in its order.

A wave's events come from its log and from the links that it leads to, in one pass over each. They are a table like any other: counted, filtered,
written, or told to an observer, which runs in the tasks. An observer is told at least once: a task that is run again tells its part again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weblathe.plans.rules import RuleList

SKIPPED = ("no-download", "duplicate", "rule-deny")
DETAILS = "skipped string, failed string, success boolean, code int, saved boolean, bail boolean, links_total long, links_followed long, tests array<struct<passed:boolean,rule:string>>"
STATES = ("follow", "save", "bail")


class Observer:
    """Methods are called with a link (a Row: url, original_url, depth, prev_url, tag, inline, source, redirect_from) and, as keywords, what is known of its state.

    open and close come before and after the events of a task. Observers travel to tasks, so what can't be pickled is made in open.
    """

    def open(self) -> None: ...

    def close(self) -> None: ...

    def added_to_queue(self, link: Row) -> None: ...

    def taken_by_processor(self, link: Row) -> None: ...

    def follow_state_changed(self, link: Row, **state) -> None: ...

    def save_state_changed(self, link: Row, **state) -> None: ...

    def bail_state_changed(self, link: Row, **state) -> None: ...

    def completed(self, link: Row) -> None: ...


def _details(**given: Column) -> Column:
    fields = [f.strip().split(" ", 1) for f in DETAILS.split(", ")]
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def events_of(log: DataFrame, links: DataFrame, traces: dict[str, RuleList] | None = None) -> DataFrame:
    """wave, depth, order, step, n, event, link, details: the events of a wave, from what on_wave is given; (depth, order, step, n) is their order.

    A link's events come together: taken, follow state, save state, bail state, the links that its page adds to the queue, completed. Seeds are added before all
    else. traces: rule lists by state (follow, save, bail), whose evaluated tests are then in the details; they may ask of links only.
    """
    for state, rules in (traces or {}).items():
        if state not in STATES or rules.kinds - {"S"}:
            raise ValueError(f"no trace of {state}: only rules about links can be evaluated again")
    tests = {k: {"tests": v.trace()} for k, v in (traces or {}).items()}
    counts = links.groupBy(F.col("p_order").alias("c_order")).agg(F.count(F.lit(1)).alias("total"), F.count_if("queued").alias("followed"))
    rows = log.join(counts, F.col("order") == F.col("c_order"), "left")
    status, done = F.col("status"), F.col("status").isin("success", "not-modified", "not-expired")
    skipped, success = F.when(status.isin(*SKIPPED), status), F.when(status == "success", True)
    failed = F.when(~status.isin(*SKIPPED) & (status != "success"), status)
    zero = lambda c: F.when(~F.col("bail"), F.coalesce(c, F.lit(0)))
    link = F.struct("url", "original_url", "depth", F.col("prev.url").alias("prev_url"), "tag", "inline", "source", "redirect_from")

    def event(step: int, name: str, when: Column = F.lit(True), **details: Column) -> Column:
        return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(name).alias("event"), _details(**details).alias("details")))

    each = F.array_compact(F.array(
        event(-1, "added_to_queue", (F.col("depth") == 0) & F.col("redirect_from").isNull()),
        event(-1, "added_to_queue", F.col("redirect_from").isNotNull()),
        event(0, "taken_by_processor"),
        event(1, "follow_state_changed", skipped=skipped, failed=failed, success=success, code=F.col("code"), **tests.get("follow", {})),
        event(2, "save_state_changed", done, saved=F.col("saved") | (status != "success"), **tests.get("save", {})),
        event(3, "bail_state_changed", done, bail=F.when(F.col("bail"), True), links_total=zero(F.col("total")), links_followed=zero(F.col("followed")), **tests.get("bail", {})),
        event(5, "completed"),
    ))
    own = rows.select("wave", F.col("depth").alias("at_depth"), "order", F.lit(0).alias("n"), F.explode(each).alias("e"), link.alias("link"))
    own = own.select("wave", F.col("at_depth").alias("depth"), "order", "e.step", "n", "e.event", "link", "e.details")
    to = F.struct(
        "url", "original_url", (F.col("p_depth") + 1).alias("depth"), F.col("p_url").alias("prev_url"), "tag", "inline", "source", F.lit(None).cast("string").alias("redirect_from"),
    )
    added = links.filter("queued").select(
        "wave", F.col("p_depth").alias("depth"), F.col("p_order").alias("order"), F.lit(4).alias("step"), F.col("n").cast("int").alias("n"), F.lit("added_to_queue").alias("event"), to.alias("link"), _details().alias("details"),
    )
    return own.unionByName(added)


def observe(events: DataFrame, observer: Observer) -> None:
    """Tells an observer of events, in ranges of their order: within a range in order, ranges side by side. No range is brought to the driver."""
    ordered = events.repartitionByRange("depth", "order").sortWithinPartitions("depth", "order", "step", "n")
    ordered.select("event", "link", "details").foreachPartition(_told(observer))


def _told(observer: Observer) -> Callable[[Iterator[Row]], None]:
    def run(rows: Iterator[Row]) -> None:
        observer.open()
        try:
            for r in rows:
                state = {k: v for k, v in r["details"].asDict().items() if v is not None}
                getattr(observer, r["event"])(r["link"], **state)
        finally:
            observer.close()

    return run


def observed(observer: Observer, traces: dict[str, RuleList] | None = None) -> Callable[[int, DataFrame, DataFrame], None]:
    """An on_wave that tells an observer of each wave."""
    return lambda number, log, links: observe(events_of(log, links, traces), observer)


def recorded(place: str, traces: dict[str, RuleList] | None = None) -> Callable[[int, DataFrame, DataFrame], None]:
    """An on_wave that writes each wave's events to place/wave=n, once however often it is run."""
    return lambda number, log, links: events_of(log, links, traces).drop("wave").write.mode("overwrite").parquet(f"{place}/wave={number}")
