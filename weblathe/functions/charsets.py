"""Text of bytes in any charset, and the way back: which bytes a run of characters came from.

Documents are rewritten by putting new bytes in place of old ones, so all that isn't a changed link stays as it was received: other charsets, bytes that the
charset doesn't have, byte order marks. A charset's characters are found in its bytes by encoding the text between two places, where encoding gives back
the bytes that were decoded; else (faulty bytes, several spellings of a character, charsets with states) by decoding step by step.
"""

from __future__ import annotations

import codecs
import re

#: Labels of charsets as the web means them, where Python's codec of that name is narrower.
LABELS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso-8859-9": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "euc-kr": "cp949", "ks_c_5601-1987": "cp949",
    "big5": "big5hkscs", "x-cp1251": "cp1251", "x-cp1252": "cp1252", "x-euc-jp": "euc_jp", "unicode": "utf-16-le", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf8": "utf-8", "x-user-defined": "latin-1",
}
#: Codecs of Python that aren't charsets of documents.
_OTHERS = {"idna", "punycode", "raw-unicode-escape", "unicode-escape", "utf-7", "utf-8-sig", "utf-16", "mbcs", "oem", "undefined", "palmos"}
_MARKS = {"utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE}
_STATES = re.compile(r"iso2022|hz")


def codec(label: str | None) -> str:
    """The name of Python's codec of a label; utf-8 for unknown ones."""
    label = (label or "utf-8").strip().lower()
    try:
        found = codecs.lookup(LABELS.get(label, label))
    except (LookupError, ValueError):
        return "utf-8"
    return found.name if found._is_text_encoding and found.name not in _OTHERS else "utf-8"


def _undefined(e: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(map(chr, e.object[e.start : e.end])), e.end  # as the web has the unused bytes of cp1252: controls


codecs.register_error("weblathe-controls", _undefined)


def _errors(name: str) -> str:
    return "weblathe-controls" if name.startswith(("cp125", "cp874")) else "replace"


def _mark(content: bytes, name: str) -> int:
    mark = _MARKS.get(name, b"")
    return len(mark) if mark and content.startswith(mark) else 0


def text_of(content: bytes | None, label: str | None) -> str:
    """The text, without a byte order mark; what the charset doesn't have is U+FFFD."""
    content = content or b""
    name = codec(label)
    return content[_mark(content, name) :].decode(name, _errors(name))


def places(content: bytes, label: str | None, wanted: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """The places in bytes of places in characters of text_of(content, label): (start, end) in ascending order, without overlaps. None for faulty bytes in a charset with states, whose
    later characters can't be told apart from them."""
    name = codec(label)
    first = _mark(content, name)
    body = content[first:]
    stateful = bool(_STATES.search(name))
    text = body.decode(name, _errors(name))
    if not stateful:
        try:
            if text.encode(name) == body:
                out, at, char = [], first, 0
                for start, end in wanted:
                    at += len(text[char:start].encode(name))
                    stop = at + len(text[start:end].encode(name))
                    out.append((at, stop))
                    at, char = stop, end
                return out
        except UnicodeEncodeError:
            pass
    try:
        begins, ends = _stepwise(body, name) if stateful else _by_segments(body, name)
    except UnicodeDecodeError:
        return None
    begins, ends = [*begins, len(body)], [0, *ends]
    return [(first + begins[a], first + ends[b] if b > a else first + begins[a]) for a, b in wanted]


def _stepwise(body: bytes, name: str) -> tuple[list[int], list[int]]:
    """Where each character begins and ends, by decoding a byte at a time."""
    decoder = codecs.getincrementaldecoder(name)("strict")
    begins, ends, clean = [], [], 0
    for at in range(len(body)):
        n = len(decoder.decode(body[at : at + 1]))
        done = at + 1 - len(decoder.getstate()[0])
        for k in range(n):
            begins.append(clean), ends.append(done if k == n - 1 else clean)
        if done > clean:
            clean = done
    decoder.decode(b"", True)
    return begins, ends


def _by_segments(body: bytes, name: str) -> tuple[list[int], list[int]]:
    """As _stepwise, for charsets without states: faulty bytes by what the decoder said of them, the rest between them."""
    own = _errors(name)

    def noted(e: UnicodeDecodeError) -> tuple[str, int]:
        made, stop = codecs.lookup_error(own)(e)
        faults.append((e.start, stop, len(made)))
        return made, stop

    faults: list[tuple[int, int, int]] = []
    codecs.register_error("weblathe-noted", noted)
    body.decode(name, "weblathe-noted")
    begins: list[int] = []
    ends: list[int] = []
    at = 0
    for start, stop, n in [*faults, (len(body), len(body), 0)]:
        part = body[at:start]
        text = part.decode(name)
        if text.encode(name, "ignore") == part:
            for c in text:
                begins.append(at)
                at += len(c.encode(name))
                ends.append(at)
        else:
            b, e = _stepwise(part, name)
            begins += [at + x for x in b]
            ends += [at + x for x in e]
        begins += [min(start + k, stop) for k in range(n)]
        ends += [stop if k == n - 1 else min(start + k + 1, stop) for k in range(n)]
        at = stop
    return begins, ends


def bytes_of(text: str, label: str | None, is_css: bool = False) -> bytes:
    """text in a charset; characters that it doesn't have as references of HTML, or escapes of CSS."""
    name = codec(label)
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        if is_css:
            text = "".join(c if c.encode(name, "ignore") else f"\\{ord(c):x} " for c in text)
        return text.encode(name, "xmlcharrefreplace")


def spliced(content: bytes, label: str | None, changes: list[tuple[int, int, str, bool]]) -> bytes:
    """content with runs of characters (start, end, new text, whether in a style sheet) replaced, and every other byte as it was. Content whose places aren't known stays."""
    out, at = [], 0
    for (start, end), (_, _, new, is_css) in zip(places(content, label, [c[:2] for c in changes]) or [], changes):
        out += [content[at:start], bytes_of(new, label, is_css)]
        at = end
    return b"".join([*out, content[at:]])
