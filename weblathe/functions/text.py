"""Globs, unit literals, dates, content types, shortening: small functions of the rule language and the mirror."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"k": 1e3, "m": 1e6, "g": 1e9}
#: File endings of content types; the first is the one to write.
EXTENSIONS = {
    "text/html": [".html", ".htm"], "text/css": [".css"], "text/plain": [".txt"], "text/javascript": [".js"], "application/javascript": [".js"],
    "application/json": [".json"], "application/xml": [".xml"], "application/pdf": [".pdf"], "image/png": [".png"], "image/gif": [".gif"],
    "image/jpeg": [".jpg", ".jpeg", ".jpe"], "image/svg+xml": [".svg"], "image/x-icon": [".ico"], "application/zip": [".zip"],
    "application/gzip": [".gz"], "application/msword": [".doc"], "application/octet-stream": [".so", ".o", ".obj", ".exe", ".dll", ".bin", ".a"], "application/postscript": [".ps", ".eps", ".ai"],
    "application/vnd.ms-excel": [".xls"], "application/vnd.ms-powerpoint": [".ppt"], "application/wasm": [".wasm"], "application/x-tar": [".tar"], "application/xhtml+xml": [".xhtml"],
    "audio/mpeg": [".mp3", ".mp2"], "audio/ogg": [".ogg"], "audio/x-wav": [".wav"], "font/ttf": [".ttf"], "font/woff": [".woff"], "font/woff2": [".woff2"], "image/avif": [".avif"], "image/bmp": [".bmp"],
    "image/tiff": [".tiff", ".tif"], "image/vnd.microsoft.icon": [".ico"], "image/webp": [".webp"], "text/csv": [".csv"], "text/xml": [".xml"], "video/mp4": [".mp4"], "video/mpeg": [".mpeg", ".mpe", ".mpa"], "video/webm": [".webm"],
}


def number(literal: str) -> float | None:
    """A numeric literal, with K, M or G for thousands, millions and billions; None if it isn't one."""
    factor, text = 1.0, literal
    if literal and literal[-1].lower() in UNITS:
        factor, text = UNITS[literal[-1].lower()], literal[:-1]
    try:
        return float(text) * factor
    except ValueError:
        return None


def glob_pattern(glob: str) -> str:
    """A Java pattern of the whole text: * ? [set] [!set]; everything else is literal and a dot may be a line's end."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (m := re.compile(r"(!?)(\]?[^\]]*)\]").match(glob, i)):
            i = m.end()
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", m[2])
            out.append(f"[{'^' if m[1] else ''}{inner}]")
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def glob(value: Column, pattern: str) -> Column:
    """Case-sensitive match of the whole text, by the cheapest expression."""
    if not re.search(r"[*?\[]", pattern):
        return value == pattern
    if re.fullmatch(r"[^*?\[]*\*", pattern):
        return value.startswith(pattern[:-1])
    if re.fullmatch(r"\*[^*?\[]*", pattern):
        return value.endswith(pattern[1:])
    return value.rlike(glob_pattern(pattern))


def http_date(value: Column) -> Column:
    """TIMESTAMP_NTZ of an HTTP date in any of its three forms, without its zone; null if it can't be read."""
    clock = r"(\d{2}:\d{2}:\d{2})"
    usual = F.regexp_replace(F.regexp_extract(value, r"\d{1,2}[ -][A-Za-z]{3}[a-z]*[ -]\d{4} " + clock, 0), "-", " ")
    part = lambda p, i: F.regexp_extract(value, p, i)
    short = r"(\d{1,2})-([A-Za-z]{3})-(\d{2}) " + clock
    century = F.when(part(short, 3) >= "69", "19").otherwise("20")
    plain = r"([A-Za-z]{3}) +(\d{1,2}) " + clock + r" (\d{4})"
    each = [usual, F.concat_ws(" ", part(short, 1), part(short, 2), F.concat(century, part(short, 3)), part(short, 4)), F.concat_ws(" ", part(plain, 2), part(plain, 1), part(plain, 4), part(plain, 3))]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit("d MMM yyyy HH:mm:ss")) for x in each]).cast("timestamp_ntz")


def mime(header: Column) -> Column:
    """The content type without its parameters, as it stands."""
    return F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))


def extensions(mime_: Column) -> Column:
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mime_), F.array().cast("array<string>"))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, with ... for what is left out of the middle."""
    head = (n - 3 + 1) // 2
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(n - 3 - head))))


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").when(~value, "no").otherwise("")
