"""Urls as Columns: normalise, split, join, relate. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B.
PARTS = r"(?s)\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def full_path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def path(url: Column) -> Column:
    """Without the parameters of its last segment."""
    return F.regexp_replace(full_path(url), r"(?s)\A((?:.*/)?[^/;]*);[^/]*\z", "$1")


def params(url: Column) -> Column:
    return F.regexp_extract(full_path(url), r"(?s)\A(?:.*/)?[^/;]*;([^/]*)\z", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 5)


def port(url: Column) -> Column:
    """The explicit port; null if there is none."""
    return F.regexp_extract(netloc(url), r":(\d+)\z", 1).try_cast("int")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_dots(path: Column) -> Column:
    """Removes . and .. segments; paths without any aren't taken apart."""
    segments = F.split(path, "/", -1)

    def step(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(s == ".", done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.element_at(segments, -1).isin(".", "..")
    joined = F.concat(F.array_join(folded, "/"), F.when(ends, "/").otherwise(""))
    return F.when(F.concat(F.lit("/"), path, F.lit("/")).rlike(r"/\.\.?/"), joined).otherwise(path)


def normalise(raw: Column) -> Column:
    """The url with its fragment: scheme and host in lower case, no default port, no empty query, at least `/` as
    path, no dot segments. Null if there is no scheme or no host. Percent-encoding stays as it is."""
    return let(F.regexp_replace(raw, r"\A\s+|\s+\z", ""), _normalised)


def _normalised(text: Column) -> Column:
    s, n, p, q, f = scheme(text), netloc(text), full_path(text), query(text), fragment(text)
    user, host_ = F.regexp_extract(n, r"\A(.*@)?", 0), F.lower(F.regexp_replace(n, r"\A.*@", ""))
    port_ = F.when(s == "http", r":(?:80)?\z").when(s == "https", r":(?:443)?\z").otherwise(r":\z")
    host_ = F.regexp_replace(host_, port_, F.lit(""))
    out = F.concat(
        s, F.lit("://"), user, host_, let(F.when(p == "", "/").otherwise(p), without_dots),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""),
    )
    return F.when((s != "") & (host_ != ""), out)


def canonical(original: Column) -> Column:
    """The key of a document: no fragment, http for https."""
    return F.regexp_replace(F.regexp_replace(original, r"(?s)#.*\z", ""), r"\Ahttps:", "http:")


def join(base: Column, ref: Column) -> Column:
    """The url that ref means in a document at base (RFC 3986, 5.2)."""
    return let(base, lambda b: let(ref, lambda r: _joined(b, r)))


def _joined(base: Column, ref: Column) -> Column:
    rs, rn, rp, rq, rf = scheme(ref), netloc(ref), full_path(ref), query(ref), fragment(ref)
    authority = F.regexp_extract(base, r"(?s)\A([^:/?#]+:)?(//[^/?#]*)?", 0)
    folder = F.regexp_extract(full_path(base), r"(?s)\A(.*/)?", 1)
    folder = F.when((folder == "") & (netloc(base) != ""), "/").otherwise(folder)
    merged = let(F.when(rp.startswith("/"), rp).otherwise(F.concat(folder, rp)), without_dots)
    own_query = F.when(ref.rlike(r"\A[^#]*\?") & (rq != ""), F.concat(F.lit("?"), rq))
    base_query = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    tail = F.when(rf != "", F.concat(F.lit("#"), rf)).otherwise("")
    return (
        F.when(ref == "", base)
        .when(rs != "", ref)
        .when(ref.startswith("//") & (rn != ""), F.concat(F.regexp_extract(base, r"\A([^:/?#]+:)?", 0), ref))
        .when(rp == "", F.concat(authority, full_path(base), F.coalesce(own_query, base_query), tail))
        .otherwise(F.concat(authority, merged, F.coalesce(own_query, F.lit("")), tail))
    )


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def extension(name: Column) -> Column:
    """Without its dot; leading dots don't make an extension."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*\.([^.]*)\z", 1)


def path_level(path: Column) -> Column:
    return F.size(F.split(path, "/", -1)) - 2


def path_distance(netloc_: Column, path_: Column, other_netloc: Column, other_path: Column) -> Column:
    """How many levels further down, if one path's segments start the other's on one host; else null."""
    a, b = F.split(path_, "/", -1), F.split(other_path, "/", -1)
    n = F.least(F.size(a), F.size(b))
    related = (netloc_ == other_netloc) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))
    return F.when(related, F.size(a) - F.size(b))


def relative(target: Column, source_file: Column) -> Column:
    """The path to file target from the folder of source_file, from ./ on."""
    to, at = F.split(target, "/"), F.split(F.regexp_replace(source_file, r"/?[^/]*\z", ""), "/")
    at = F.filter(at, lambda x: x != "")

    def of(t: Column, a: Column) -> Column:
        places = F.sequence(F.lit(0), F.least(F.size(t) - 1, F.size(a)))
        same = F.array_max(F.filter(places, lambda k: F.slice(t, F.lit(1), k) == F.slice(a, F.lit(1), k)))
        up = F.repeat(F.lit("../"), (F.size(a) - same).cast("int"))
        return F.concat(F.lit("./"), up, F.array_join(F.slice(t, same + 1, F.size(t)), "/"))

    return let(to, lambda t: let(at, lambda a: of(t, a)))


def link_parts(original: Column) -> dict[str, Column]:
    """What tests need of a normalised url."""
    return {
        "url": canonical(original), "scheme": scheme(original), "netloc": netloc(original), "port": port(original),
        "path": path(original), "params": params(original), "query": query(original), "fragment": fragment(original),
        "is_https": original.startswith("https:"),
    }
