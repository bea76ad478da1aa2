import fnmatch
import itertools

import pytest
from pyspark.sql import functions as F

from weblathe.cli import parse as parse_argv
from weblathe.plans import rules as R


VALUES = {"bool": [True, False], "int": [-3, 0, 7, 2500, None], "str": ["", "moss", "moss.txt", "fern"]}
LITERALS = ["", "0", "1", "7", "2k", "3K", "word", "mo*", "*.txt", "f?rn", "moss"]


def plainly(type, value, op, literal, undefined):
    """The rules of the language: one value and one literal."""
    if not op:
        return bool(value)
    if type == "str":
        equal = fnmatch.fnmatchcase(value, literal)
        return {"=": equal, "!=": not equal, "<": value < literal, ">": value > literal, "<=": value <= literal, ">=": value >= literal}[op]
    units = {"k": 1000, "m": 10**6, "g": 10**9}
    number = int(literal) if literal.isdigit() else int(literal[:-1]) * units[literal[-1].lower()] if literal[:-1].isdigit() and literal[-1].lower() in units else None
    left = (1 if value else None) if type == "bool" else value
    if number is None:  # both undefined: they are equal where an undefined value is the same undefined
        same = left is None and (type == "bool" or undefined == "false")
        return {"=": same, "<=": same, ">=": same, "!=": not same}.get(op, False)
    if left is None:
        return op == "!="
    return {"=": left == number, "!=": left != number, "<": left < number, ">": left > number, "<=": left <= number, ">=": left >= number}[op]


@pytest.mark.parametrize("undefined", ["false", "none"])
@pytest.mark.parametrize("type", sorted(VALUES))
def test_operators(spark, type, undefined):
    """Every operator, value and literal against an evaluation of one at a time."""
    kind = {"bool": "boolean", "int": "int", "str": "string"}[type]
    t = R.Test("t", lambda: F.col("v"), type, "S", undefined)
    cases = [(op, x) for op in ("", *R.OPERATORS) for x in LITERALS]
    df = spark.createDataFrame([(v,) for v in VALUES[type]], f"v {kind}")
    rows = df.select("v", *[R.passes(R.Rule(True, False, t, op, x, "")).alias(f"c{i}") for i, (op, x) in enumerate(cases)]).collect()
    for r in rows:
        for i, (op, x) in enumerate(cases):
            assert r[f"c{i}"] is plainly(type, r["v"], op, x, undefined), (type, r["v"], op, x)


@pytest.mark.parametrize("bad", ["depth", "", "+nope", "+depth==1", "+depth<>1", "*depth", None])
def test_errors(bad):
    with pytest.raises(R.RuleError):
        R.RuleList([bad])


def naive(rules, values):
    result, trace = False, []
    for r in rules:
        sign, stops, name = r[0], r[1:2] in ("+", "-"), r.lstrip("+-")
        p = True if not name else values[name]
        if p and stops:
            return sign == "+", trace
        trace.append(p)
        if p:
            result = sign == "+"
    return result, trace


def test_all_lists_of_three_rules(spark, monkeypatch):
    """The fold against an interpreter that goes from left to right."""
    for n in ("depth", "domain-depth"):
        monkeypatch.setitem(R.TESTS, n, R.Test(n, lambda n=n: F.col(n.replace("-", "_")) == 1, "bool"))
    every = [s + n for s in ("+", "-", "++", "--") for n in ("", "depth", "domain-depth")]
    lists = list(itertools.product(every, repeat=3))[::7]
    df = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "depth int, domain_depth int").coalesce(1)
    for at in range(0, len(lists), 60):
        part = lists[at : at + 60]
        compiled = [R.RuleList(list(x)) for x in part]
        got = df.select("*", *[r.column().alias(f"r{i}") for i, r in enumerate(compiled)], *[F.transform(r.trace(), lambda x: x["passed"]).alias(f"t{i}") for i, r in enumerate(compiled)]).collect()
        for row in got:
            values = {"depth": row["depth"] == 1, "domain-depth": row["domain_depth"] == 1}
            for i, x in enumerate(part):
                assert (row[f"r{i}"], row[f"t{i}"]) == naive(x, values), (x, values)


def test_redirects_pass_size_tests(spark):
    df = spark.createDataFrame([(200, True), (200, False)], "status int, moved boolean").withColumns({"headers": F.create_map(F.lit("content-length"), F.lit("10")), "content": F.lit("x").cast("binary")})
    got = df.select("moved", R.RuleList(["+size>1m"]).column(F.col("moved")).alias("v"), R.RuleList(["+", "-size>1m"]).column(F.col("moved")).alias("w")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, True)]


def test_command_line():
    got = parse_argv(["-O", "/m", "http://a.b", "@follow", "-", "--depth>2", "+requisite", "@stop", "+depth>3"])
    assert (got.urls, got.follow, got.save, got.stop, got.path) == (["http://a.b"], ["-", "--depth>2", "+requisite"], ["+"], ["+depth>3"], "/m")
    with pytest.raises(R.RuleError):
        parse_argv(["@nope"])
