"""The rule language: ordered `+` and `-` tests, compiled into one Column.

The last test that passes decides; a passing `++` or `--` ends the evaluation. The list is folded from the right, so
that each rule appears once and the rules that matter most are evaluated first. User literals are read at
compile time: only whether a value is undefined is left to the row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.functions import weburl as U


class RuleError(ValueError):
    """A rule that can't be read, or an unknown test or operator."""


@dataclass(frozen=True)
class Test:
    """A test of links. kind: S needs the link only, M the mirror, R the response. type: bool, int or str.

    undefined: what a null value stands for, "none" (of a response that isn't there) or "false" (of unrelated urls).
    """

    name: str
    column: Callable[[], Column]
    type: str
    kind: str = "S"
    undefined: str = "none"
    about: str = ""


TESTS: dict[str, Test] = {}


def register_test(name: str, column: Callable[[], Column], type: str, kind: str = "S", undefined: str = "none", about: str = "") -> None:
    TESTS[name] = Test(name, column, type, kind, undefined, about)


def _prev_distance() -> Column:
    c = F.col
    return F.when(c("prev").isNull(), 0).otherwise(U.path_distance(c("netloc"), c("path"), c("prev.netloc"), c("prev.path")))


def _root_distance() -> Column:
    c = F.col
    return F.when(c("prev").isNull(), 0).otherwise(U.path_distance(c("netloc"), c("path"), c("root.netloc"), c("root.path")))


def _size() -> Column:
    stated = F.try_element_at(F.col("headers"), F.lit("content-length")).try_cast("long")
    return F.when(F.col("status").isNotNull(), F.coalesce(stated, F.octet_length("content").cast("long")))


for _args in (
    ("", lambda: F.lit(True), "bool", "S", "none", "always passes"),
    ("depth", lambda: F.col("depth"), "int", "S", "none", "links from the start"),
    ("domain-depth", lambda: F.col("domain_depth"), "int", "S", "none", "links since the host changed"),
    ("original-domain", lambda: F.col("netloc").eqNullSafe(F.col("root.netloc")), "bool", "S", "none", "on the host of the start"),
    ("same-domain", lambda: F.col("prev").isNull() | (F.col("netloc") == F.col("prev.netloc")), "bool", "S", "none", "on the host of the page that links"),
    ("down", lambda: F.coalesce(_root_distance() >= 0, F.lit(False)), "bool", "S", "none", "at or below the start's path"),
    ("path-level", lambda: U.path_level(F.col("path")), "int", "S", "none", "folders in the path"),
    ("path-distance", _prev_distance, "int", "S", "false", "levels below the page that links"),
    ("path-distance-to-original", _root_distance, "int", "S", "false", "levels below the start"),
    ("url", lambda: F.col("url"), "str", "S", "none", "the canonical url"),
    ("protocol", lambda: F.col("scheme"), "str", "S", "none", "scheme of the original url"),
    ("domain", lambda: F.col("netloc"), "str", "S", "none", "host with user and port"),
    ("port", lambda: F.coalesce(F.nullif(F.col("port"), F.lit(0)), F.lit(80)), "int", "S", "none", "80 if none is stated"),
    ("path", lambda: F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/")), "str", "S", "none", "at least /"),
    ("filename", lambda: U.filename(F.col("path")), "str", "S", "none", "last segment of the path"),
    ("extension", lambda: U.extension(U.filename(F.col("path"))), "str", "S", "none", "of the file name, without the dot"),
    ("querystring", lambda: F.col("query"), "str", "S", "none", "without the question mark"),
    ("fragment", lambda: F.col("fragment"), "str", "S", "none", "of the original url"),
    ("size", _size, "int", "R", "none", "stated length, else bytes; redirects count as passed"),
    ("content-type", lambda: F.when(F.col("status").isNotNull(), T.mime(F.try_element_at(F.col("headers"), F.lit("content-type")))), "str", "R", "none", "without parameters"),
    ("content", lambda: F.when(F.col("status").isNotNull(), F.col("content").cast("string")), "str", "R", "none", "the body as text"),
    ("robots", lambda: F.lit(True), "bool", "S", "none", "always passes"),
    ("tag", lambda: F.coalesce("tag", F.lit("")), "str", "S", "none", "tag and attribute that held the link"),
    ("requisite", lambda: F.coalesce(F.col("inline") & F.col("prev").isNotNull() & F.col("prev_encountered"), F.lit(False)), "bool", "M", "none", "needed by a page that was saved"),
):
    register_test(*_args)


def describe_tests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.type, t.kind, t.about) for t in TESTS.values()], "name string, type string, kind string, about string")


@dataclass(frozen=True)
class Rule:
    positive: bool
    stops: bool
    test: Test
    op: str
    value: str
    source: str


OPERATORS = ("=", "!=", "<", ">", ">=", "<=")


def parse(source: str) -> Rule:
    m = re.fullmatch(r"(?s)([+-])([+-])?([\w-]*)\s*(?:([=!<>~]+)(.*))?", source or "")
    if not m:
        raise RuleError(f"{source!r} isn't a rule: + or - is expected first")
    sign, again, name, op, value = m.groups()
    if name not in TESTS:
        raise RuleError(f"{source!r}: there is no test {name!r}")
    if op and op not in OPERATORS:
        raise RuleError(f"{source!r}: there is no operator {op!r}")
    return Rule(sign == "+", again is not None, TESTS[name], op or "", value or "", source)


def passes(rule: Rule) -> Column:
    """Whether the rule's test passes, never null."""
    t, v = rule.test, rule.test.column()
    if not rule.op:
        return F.coalesce({"bool": v, "int": v != 0, "str": v != ""}[t.type], F.lit(False))
    if t.type == "str":
        return _text(rule.op, v, rule.value)
    number = T.number(rule.value)
    if t.type == "bool":  # true is 1; false is undefined
        v = F.when(v, 1)
    if number is not None:
        lit, v = F.lit(number), v.cast("double")
        equal = F.coalesce(v == lit, F.lit(False))
        ordered = {"<": v < lit, ">": v > lit, "<=": v <= lit, ">=": v >= lit}
        return equal if rule.op == "=" else ~equal if rule.op == "!=" else F.coalesce(ordered[rule.op], F.lit(False))
    # the literal is undefined too: it equals what is undefined in the same way
    both = v.isNull() if t.type == "bool" or t.undefined == "false" else F.lit(False)
    return {"=": both, "<=": both, ">=": both, "!=": ~both}.get(rule.op, F.lit(False))


def _text(op: str, v: Column, literal: str) -> Column:
    equal = F.coalesce(T.glob(v, literal), F.lit(False))
    lit = F.lit(literal)
    ordered = {"<": v < lit, ">": v > lit, "<=": v <= lit, ">=": v >= lit}
    return equal if op == "=" else ~equal if op == "!=" else F.coalesce(ordered[op], F.lit(False))


def rule_of(x: str | Rule | Column | Callable[[], Column]) -> Rule:
    """A rule as text, or a Column of links (or what makes one) as a rule that passes where it is true."""
    if isinstance(x, Rule):
        return x
    if x is None or isinstance(x, str):
        return parse(x)
    made = x if callable(x) and not isinstance(x, Column) else lambda: x
    return Rule(True, False, Test("column", made, "bool"), "", "", f"+column {made()}")


def response_rule(x: Column, positive: bool = True) -> Rule:
    """A Column over a response (status, headers, content, redirects, error) as a rule."""
    return Rule(positive, False, Test("column", lambda: x, "bool", "R"), "", "", f"{'+' if positive else '-'}column {x}")


class RuleList:
    """Rules in order: texts, Columns, or functions that make Columns."""

    def __init__(self, rules: list, default: bool = False):
        self.rules = [rule_of(r) for r in rules]
        self.default = default

    @property
    def kinds(self) -> set[str]:
        return {r.test.kind for r in self.rules}

    def _useful(self) -> list[Rule]:
        """Rules before an unconditional one can't decide, unless they stop."""
        last = max((i for i, r in enumerate(self.rules) if r.test.name == "" and not r.op), default=0)
        return [r for i, r in enumerate(self.rules) if i >= last or r.stops or r.test.name == "size"]

    def column(self, redirected: Column | None = None, given: dict[str, Column] | None = None) -> Column:
        """The decision. redirected: where a `size` test would see a redirect, which decides for yes whatever its sign. given: whether
        rules pass, by their source, where that is known already."""
        decided: Column = F.lit(None).cast("boolean")
        for r in reversed(self._useful()):
            p, act = given[r.source] if given and r.source in given else passes(r), F.lit(r.positive)
            seen = redirected if redirected is not None and r.test.name == "size" else None
            if seen is not None:
                p = p & ~seen
            later = F.when(seen, True) if seen is not None else F.lit(None).cast("boolean")
            if r.stops:
                decided = F.when(p, act).otherwise(F.coalesce(decided, later))
            else:
                decided = F.coalesce(decided, later, F.when(p, act))
        return F.coalesce(decided, F.lit(self.default))

    def trace(self) -> Column:
        """array<struct<passed, rule>> of the rules evaluated; the stop rule that ended the evaluation isn't in it."""
        each = F.array(*[F.struct(passes(r).alias("passed"), F.lit(r.source).alias("rule"), F.lit(r.stops).alias("stops")) for r in self.rules])

        def cut(t: Column) -> Column:
            ends = F.array_min(F.filter(F.transform(t, lambda x, i: F.when(x["passed"] & x["stops"], i)), lambda i: i.isNotNull()))
            return F.transform(F.slice(t, F.lit(1), F.coalesce(ends, F.size(t))), lambda x: F.struct(x["passed"].alias("passed"), x["rule"].alias("rule")))

        return U.let(each, cut)

    def last_passed(self) -> Column:
        """The rule that the log shows: the last one of the trace that passed."""
        return F.try_element_at(F.filter(self.trace(), lambda x: x["passed"]), F.lit(-1))["rule"]


FOLLOW, SAVE, STOP = ("-", "+requisite"), ("+",), ("-",)
