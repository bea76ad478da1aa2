"""Vectorised word and shingle fingerprints of whole texts, an Arrow batch at a time.

Words are maximal runs of bytes other than ASCII white space, after A-Z is lower-cased; a text's
shingles are its distinct runs of five words, or its whole word sequence when that is shorter.
Fingerprints have 64 bits: equality is used only between the sets of two texts or to find candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes that are worked on at a time.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[:1] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and each text's start in them (one more at the end); null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all words in order, and where each text's words begin. BLOCK bytes are worked on at a time."""
    data, offs = text_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts, hashes, size = [], [], 0  # size: of the word that the block before ends in, so far
    up, down = _power(BLOCK + 1)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK]
        word = ~_SPACE[part]
        edge = np.ones(len(part) + 1, bool)  # whether a text begins here or the byte before is white space
        edge[1:] = ~np.append(word, False)[:-1]
        edge[offs[np.searchsorted(offs, at) : np.searchsorted(offs, at + len(part), "right")] - at] = True
        edge[len(part)] |= at + len(part) == n
        goes_on = size > 0 and word[0] and not _begins(offs, at)
        first = np.flatnonzero(word & edge[:-1])  # place 0 too, as edge is true there
        after = edge[1:].copy()
        after[:-1] |= ~word[1:]
        after[-1] = True
        last = np.flatnonzero(word & after) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        sums = (total[last] - total[first]) * down[first]
        if goes_on:
            hashes[-1][-1:] += sums[:1] * np.uint64(pow(int(_BASE), size, 1 << 64))
            size = size + len(part) if last[0] == len(part) else 0
            sums, first, fresh = sums[1:], first[1:], last[1:]
        else:
            size, fresh = 0, last
        if len(fresh):
            starts.append(first + at), hashes.append(sums)
            if fresh[-1] == len(part):
                size = int(fresh[-1] - first[-1])
    starts = np.concatenate([np.zeros(0, np.int64), *starts])
    return mix(np.concatenate([np.zeros(0, np.uint64), *hashes])), np.searchsorted(starts, offs)


def _begins(offs: np.ndarray, at: int) -> bool:
    """Whether a text begins at this byte."""
    k = np.searchsorted(offs, at)
    return bool(k < len(offs) and offs[k] == at)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, end to end, and where each text's begin."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    sums = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        sums[: n - k] += words[k:] * _STEP[k]
    full = np.maximum(count - SHINGLE + 1, 0)
    sizes = np.where(count >= SHINGLE, full, np.minimum(count, 1))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(at[:-1] - firsts[:-1], sizes) + np.arange(firsts[-1])
    out = sums[source]
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        c = count[i]
        out[firsts[i]] = np.append(words[at[i] : at[i + 1]] * _STEP[:c], _SHORT[c]).sum(dtype=np.uint64)
    out = mix(out)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[firsts[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[firsts]
