"""Scanners of HTML and CSS: where a document mentions urls.

These are the only functions of the engine that run in Python. They look for mentions with compiled patterns, and
leave everything relational (absolutising, normalising, tests, rewriting) to Columns.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple


class Mention(NamedTuple):
    pos: int  # of the text to replace, in characters
    len: int
    raw: str
    inline: bool
    tag: str | None
    do_not_follow: bool
    base: str | None  # the document's <base>, where it applies
    quote: str  # how a replacement is written: attr, style-attr, css, plain (as it is), or keep (not at all)


#: Tags and attributes that hold urls, and whether what they name is part of the page.
ATTRIBUTES = {
    "a": {"href": False}, "area": {"href": False}, "img": {"href": True, "src": True, "lowsrc": True}, "script": {"src": True}, "applet": {"code": True},
    "bgsound": {"src": True}, "body": {"background": True}, "embed": {"src": True}, "fig": {"src": True}, "frame": {"src": True}, "iframe": {"src": True},
    "input": {"src": True}, "layer": {"src": True}, "object": {"data": True}, "overlay": {"src": True}, "table": {"background": True},
    "td": {"background": True}, "th": {"background": True},
}
REQUISITE_RELS = {"stylesheet", "icon", "apple-touch-icon"}

_CSS = re.compile(
    r"""/\*.*?(?:\*/|\Z)|@import\s*(?P<i>"(?:\\.|[^"\\\n\r])*"?|'(?:\\.|[^'\\\n\r])*'?)|url\(\s*(?P<u>"(?:\\.|[^"\\\n\r])*"?|'(?:\\.|[^'\\\n\r])*'?|(?:\\.|[^)\\\n\r"'\s])(?:\\.|[^)\\\n\r])*)""",
    re.S,
)
_MARKUP = re.compile(r"<!--(?!\[if IE ).*?(?:-->|\Z)|<!(?:--\[if IE )?[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(?P<end>>)|(?P<name>[^\s=>/][^\s=>/]*)(?P<eq>\s*=\s*(?:"(?P<dq>[^"]*)(?:"|\Z)|'(?P<sq>[^']*)(?:'|\Z)|(?P<uq>[^\s>"'][^\s>]*))?)?|(?P<odd>=))""", re.S)
#: Fixed value: the url of a refreshing page.
_REFRESH = re.compile(r".*?url=(.*)", re.I)


def css(text: str) -> list[tuple[int, int, str]]:
    """(position, length, url) of what a style sheet mentions; the place includes quotes."""
    out = []
    for m in _CSS.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        found = m[kind]
        url = found
        if found[0] in "\"'":
            url = found[1:-1] if len(found) > 1 and found[-1] == found[0] and not found.endswith("\\" + found[0]) else found[1:]
        out.append((m.start(kind), len(found), re.sub(r"\\(.)", r"\1", url, flags=re.S)))
    return out


def css_mentions(text: str) -> list[Mention]:
    return [Mention(p, n, u, True, None, False, None, "css") for p, n, u in css(text or "") if u]


def html_mentions(text: str) -> list[Mention]:
    """All urls of a page in the order of their elements; <base> counts for the whole page, also before it."""
    text = text or ""
    out: list[Mention] = []
    base, at = None, 0
    while m := _MARKUP.search(text, at):
        at = m.end()
        if not m["tag"]:
            continue
        tag, first, places = m["tag"].lower(), {}, []
        while a := _ATTRIBUTE.match(text, at):
            at = a.end()
            if a["end"]:
                break
            if not a["name"]:
                continue
            name = a["name"].lower()
            kind = next((k for k in ("dq", "sq", "uq") if a[k] is not None), None)
            if kind is None:
                first.setdefault(name, None)
                continue
            value = a[kind] if kind == "uq" else html.unescape(a[kind])
            start, end = a.span(kind)
            if kind != "uq":  # the place includes the quotes
                start, end = start - 1, min(len(text), end + 1)
            first.setdefault(name, value)
            places.append((name, start, end, value))
        for name, start, end, value in places:
            if name == "style":
                out += [Mention(start, end - start, u, True, None, False, "", "style-attr") for _, _, u in css(value) if u]
            url = value.strip()
            if not url:
                continue
            if tag in ATTRIBUTES and name in ATTRIBUTES[tag]:
                out.append(Mention(start, end - start, url, ATTRIBUTES[tag][name], f"{tag}.{name}", False, "", "attr"))
            elif (tag, name) == ("link", "href"):
                rels = {x.strip() for x in (first.get("rel") or "").split(" ")}
                out.append(Mention(start, end - start, url, bool(rels & REQUISITE_RELS), "link.href", False, None, "attr"))
            elif (tag, name) == ("form", "action"):
                out.append(Mention(start, end - start, url, False, "form.action", True, None, "attr"))
            elif (tag, name) == ("base", "href") and base is None:
                base = url
            elif (tag, name) == ("meta", "content") and (first.get("name") or "").lower() != "robots" and (first.get("http-equiv") or "").lower() == "refresh":
                if (r := _REFRESH.match(value)) and r[1].strip():
                    out.append(Mention(start, end - start, r[1].strip(), False, "meta.content", False, None, "keep"))
        if tag in ("style", "script"):
            close = re.compile(rf"</{tag}(?=[\s/>=])", re.I).search(text, at)
            end = close.start() if close else len(text)
            if tag == "style":
                out += [Mention(at + p, n, u, True, None, False, "", "css") for p, n, u in css(text[at:end]) if u]
            at = end
    return [x._replace(base=base) if x.base == "" else x for x in out]


def style_attribute(place: str, new: dict[str, str | None]) -> str:
    """A style attribute with the urls that new has replaced."""
    quote = place[0] if place[0] in "\"'" else ""
    inner = html.unescape(place.strip(quote)) if quote else place
    out, at = [], 0
    for p, n, u in css(inner):
        if new.get(u) is not None:
            out += [inner[at:p], "'" + new[u].replace("'", "\\'") + "'"]
            at = p + n
    return '"' + "".join([*out, inner[at:]]).replace('"', "&quot;") + '"'


def replacement(quote: str, new: str) -> str:
    """How a new url is written in place of an old one."""
    if quote == "attr":
        return '"' + new.replace('"', "&quot;") + '"'
    return '"' + new.replace('"', '\\"') + '"'


def changes(text: str, is_css: bool, new: dict[str, str | None], mentions=None) -> list[tuple[int, int, str, bool]]:
    """What rewriting replaces: start, end, the new text, and whether it stands in a style sheet; in order. mentions: of another kind of document."""
    out, done = [], -1
    find = mentions or (css_mentions if is_css else html_mentions)
    for m in sorted(find(text)):
        if m.quote == "keep" or new.get(m.raw) is None or m.pos == done:
            continue
        place = text[m.pos : m.pos + m.len]
        made = style_attribute(place, new) if m.quote == "style-attr" else new[m.raw] if m.quote == "plain" else replacement(m.quote, new[m.raw])
        out.append((m.pos, m.pos + m.len, made, m.quote == "css"))
        done = m.pos
    return out


def rewritten(text: str, is_css: bool, new: dict[str, str | None], mentions=None) -> str:
    """text with its mentions of new's keys (raw urls) replaced; text itself if nothing changes."""
    out, at = [], 0
    for start, end, made, _ in changes(text, is_css, new, mentions):
        out += [text[at:start], made]
        at = end
    return "".join([*out, text[at:]])
