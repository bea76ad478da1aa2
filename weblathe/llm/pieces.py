"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

A batch's texts are concatenated and cut into units: before every space mark, and between characters that lie side by side in no piece, as
nothing is merged across such a border. Units that the worker has seen lately keep their ids; the other distinct ones are concatenated and
indexed: a suffix array over the first characters of each suffix, as many as the longest piece has. Binary search finds every piece's range
of occurrences; these become edges, which are sorted by the position they end at and relaxed from left to right. A unit of any length
(a text of one letter, say) is indexed and relaxed window by window, so memory doesn't grow with texts beyond their own bytes.

In a BPE model the best path isn't the one of the best scores: the result is what merging the best pair again and again
leaves. That result is the only path whose neighbours are each what merging leaves of their concatenation; so an edge
is relaxed if it is compatible with the last edge of the path to its start. Whether two pieces are is told by undoing
their merges, latest first, and looking for a merge across the border that would have come before.

The pieces of several space marks all have one, lowest score, so runs of single marks are joined last, from the left. Characters without a piece become their UTF-8 bytes. Models whose normalizer rewrites text, that aren't BPE, or
that have user-defined pieces are refused.

Null and empty texts have no ids and decode to the empty text. Rows stand alone: repeated rows, null ids and an empty table are
fine; other columns pass through unless their names are those of the results. A literal space mark in a text decodes to a
space, as it does in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import small_batches, table
from weblathe.llm.jaccard_join import slices

MARK = "▁"
#: Units whose ids a worker keeps from one slice to the next, about.
REMEMBERED = 300_000
#: Bytes of text that are encoded at a time.
SLICE = 3_000_000
#: Characters of new units that are indexed at a time.
INDEXED = 400_000
#: Units of more characters are indexed in windows.
LONG, WINDOW = 200, 50_000
_FAR = np.iinfo(np.int64).max


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or 4 in kinds or 6 not in kinds:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and an identity normalizer is asked for")
        self.byte = np.zeros(256, np.int64)
        self.text = [b""] * len(spec.pieces)
        scored, runs = [], {}
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.text[i] = p.piece.replace(MARK, " ").encode()
                if len(p.piece) > 1 and not p.piece.strip(MARK):
                    runs[len(p.piece)] = i
                else:
                    scored.append((-p.score, i, p.piece))
            elif p.type == 2:
                self.text[i] = " ⁇ ".encode()
        self.runs = runs
        runs[1] = next(i for _, i, x in scored if x == MARK)
        if any(MARK in x[1:] for *_, x in scored):
            raise ValueError("pieces with a space mark inside aren't supported")
        self._merges(scored)

    def _merges(self, scored: list[tuple]) -> None:
        """Ranks (0: a character), the pair that each piece is merged from last, and all pairs that merge."""
        at = {x: i for _, i, x in scored}
        self.ids = at
        n = len(self.text)
        self.rank = np.zeros(n + 1, np.int64)  # the last stands for a character without a piece
        for r, (_, i, x) in enumerate(sorted(scored)):
            self.rank[i] = 0 if len(x) == 1 else r + 1
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs, reached = {}, np.zeros(n + 1, bool)
        reached[n] = True
        rank = self.rank.tolist()
        for _, i, x in sorted(scored, key=lambda s: rank[s[1]]):
            for k in range(1, len(x)):
                if x[:k] in at and x[k:] in at:
                    pairs[at[x[:k]], at[x[k:]]] = i
            parts = list(x)
            while len(parts) > 1:
                got = [(rank[at[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in at]
                if not got:
                    break
                k = min(got)[1]
                if len(parts) == 2:
                    self.left[i], self.right[i] = at.get(parts[0], n), at.get(parts[1], n)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            reached[i] = len(parts) == 1
        self.reached = reached
        keys = np.array([a * (n + 1) + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], self.rank[np.array(list(pairs.values()))[order]]
        alphabet = sorted({c for x in at for c in x})
        self.code = np.full(0x110000, 0xFFFF, np.uint16)  # no piece has such a character
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.code[0x20] = self.code[ord(MARK)]
        usable = [(x, i) for x, i in at.items() if reached[i]]
        self.longest = max(len(x) for x, _ in usable)
        self.piece_id = np.array([i for _, i in usable])
        self.piece_len = np.array([len(x) for x, _ in usable])
        self.length = np.ones(n + 1, np.int64)
        self.length[self.piece_id] = self.piece_len
        self.spelled = np.zeros((len(usable), -(-self.longest // 8) * 8), np.uint16)
        for row, (x, _) in enumerate(usable):
            self.spelled[row, : len(x)] = self.code[[ord(c) for c in x]]
        self.beside = np.unique(np.array([(int(self.code[ord(x)]) << 16) | int(self.code[ord(y)]) for t, _ in usable for x, y in zip(t, t[1:])], np.uint32))
        size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        #: The bytes of all pieces, end to end, as decoding takes them.
        self.bytes_of, self.bytes_at = np.frombuffer(b"".join(self.text), np.uint8), np.concatenate(([0], np.cumsum(size)))
        self.forget()

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the concatenation of two pieces leaves these two."""
        out = np.ones(len(a), bool)
        row = np.arange(len(a))
        before = np.full(len(a), _FAR)
        n = np.int64(len(self.text) + 1)
        while len(row):
            key = a.astype(np.int64) * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = (self.pair_keys[at] == key) & (self.pair_rank[at] < before)
            out[row[across]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~across & ((ra > 0) | (rb > 0))
            row, a, b, ra, rb = row[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            # what was merged last is undone; of equal merges the left one came first
            before = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start and the piece of every occurrence of a piece in these codes, from a suffix array of them."""
        # codes of the batch: as many characters as fit go into one number to compare
        here = np.flatnonzero(np.bincount(codes, minlength=0x10000))
        here = here[(here != 0) & (here != 0xFFFF)]
        bits = 8 if len(here) < 255 else 16
        to = np.zeros(0x10000, np.uint16)
        to[here] = np.arange(1, len(here) + 1)
        first_two = np.zeros(1 << 16, bool) if bits == 8 else None
        rows = np.flatnonzero(to[self.spelled[:, 0]] != 0)
        if first_two is not None and len(codes) > 1:  # other pieces can't occur
            small = to[codes].astype(np.uint32)
            first_two[(small[:-1] << 8) | small[1:]] = True
            second = to[self.spelled[rows, 1]].astype(np.uint32)
            rows = rows[(self.piece_len[rows] == 1) | first_two[(to[self.spelled[rows, 0]].astype(np.uint32) << 8) | second] & (second != 0)]
        rows = rows[(to[self.spelled[rows]] != 0).sum(axis=1) == self.piece_len[rows]]
        low = to[self.spelled[rows]]
        high = np.where(low == 0, np.uint16((1 << bits) - 1), low)
        places = np.flatnonzero((codes != 0) & (codes != 0xFFFF))
        keys = _windows(to[codes], places, low.shape[1], bits)
        order = np.lexsort(keys.T[::-1])
        suffixes, keys = places[order].astype(np.int32), keys[order]
        del order, places
        first, last = _search(keys, _packed(low, bits), False), _search(keys, _packed(high, bits), True)
        count = last - first
        which = np.repeat(np.arange(len(count), dtype=np.int32), count)
        at = np.repeat((first - np.concatenate(([0], np.cumsum(count)))[:-1]).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        return suffixes[at], rows.astype(np.int32)[which]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, end to end, and where each unit's begin."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        codes = self.code[text]
        codes[starts + sizes] = 0
        start, row = self._edges(codes)
        small = lambda x: x.astype(np.int32)  # noqa: E731  edges are many: four bytes for each of their ends
        piece, end = small(self.piece_id)[row], start + small(self.piece_len)[row]
        del row
        alone = small(np.flatnonzero(codes == 0xFFFF))
        none = np.int32(len(self.text))
        start, end, piece = np.concatenate((start, alone)), np.concatenate((end, alone + np.int32(1))), np.concatenate((piece, np.full(len(alone), none)))
        offset = end - small(np.repeat(starts, sizes + 1))[start]
        order = small(np.argsort(offset, kind="stable"))
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        del order
        last_piece = np.full(len(codes) + 1, -1, np.int32)  # of the path to a position
        begins = np.zeros(len(codes) + 1, bool)
        begins[starts] = True
        cuts = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1], True]) if len(offset) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            ok = begins[s]
            rest = np.flatnonzero(~ok)
            ok[rest] = self.compatible(last_piece[s[rest]], p[rest])
            last_piece[e[ok]] = p[ok]
        return self._back(starts, sizes, last_piece, text)

    def long_word(self, word: str) -> np.ndarray:
        """The ids of one unit of any length, in bounded memory: it is indexed window by window and relaxed from place to place."""
        text = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, n = self.code[text], len(text)
        last, none, fits = np.full(n + 1, -1, np.int32), len(self.text), {}
        for at in range(0, n, WINDOW):
            low = max(0, at - self.longest + 1)
            start, row = self._edges(codes[low : at + WINDOW])
            start, piece = start.astype(np.int64) + low, self.piece_id[row]
            end = start + self.piece_len[row]
            alone = np.flatnonzero(codes[at : at + WINDOW] == 0xFFFF) + at
            start, end, piece = np.concatenate((start, alone)), np.concatenate((end, alone + 1)), np.concatenate((piece, np.full(len(alone), none)))
            order = np.argsort(end, kind="stable")
            order = order[end[order] > at]
            for s, e, p in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist()):
                if s:
                    pair = (int(last[s]), p)
                    if pair not in fits:
                        fits[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if not fits[pair]:
                        continue
                last[e] = p
        return self._back(np.zeros(1, np.int64), np.array([n]), last, text)[0]

    def learn(self, units: list[str]) -> None:
        """Puts the ids of distinct units that aren't known yet into the table; they are indexed in runs of bounded size."""
        short = [x for x in units if len(x) <= LONG]
        run = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)) + 1) // INDEXED
        cuts = np.searchsorted(run, np.arange(run[-1] + 2)).tolist() if short else [0]
        for a, b in zip(cuts, cuts[1:]):
            self._remember(short[a:b], *self.words(short[a:b]))
        for x in units:
            if len(x) > LONG:
                ids = self.long_word(x)
                self._remember([x], ids, np.array([0, len(ids)]))

    def _remember(self, units: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        known, end = len(self.known), int(self.ends[len(self.known)])
        self.known.update(zip(units, range(known, known + len(units))))
        fits = lambda x, n: x if n <= len(x) else np.concatenate((x, np.zeros(max(n, len(x) // 2), x.dtype)))
        self.store, self.ends = fits(self.store, end + len(ids)), fits(self.ends, known + len(units) + 1)
        self.store[end : end + len(ids)] = ids
        self.ends[known : known + len(units) + 1] = at + end

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: The ids of the known units, end to end, and where each unit's begin.
        self.store, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _back(self, starts, sizes, last_piece, text):
        at, word = starts + sizes, np.arange(len(starts))
        steps = []
        keep = sizes > 0
        at, word = at[keep], word[keep]
        while len(at):
            p = last_piece[at]
            at = at - self.length[p]
            steps.append((word, p, at))
            more = at > starts[word]
            at, word = at[more], word[more]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
        word, piece, at = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(at, kind="stable")  # words lie one after another, so position orders them all
        word, piece, at = word[order], piece[order], at[order]
        bad = np.flatnonzero(piece == len(self.text))
        if len(bad):
            parts = [chr(c).encode("utf-8", "surrogatepass") for c in text[at[bad]].tolist()]
            many = np.ones(len(piece), np.int64)
            many[bad] = [len(x) for x in parts]
            to = np.cumsum(many) - many
            word, piece = np.repeat(word, many), np.repeat(piece, many)
            piece[np.concatenate([np.arange(t, t + len(x)) for t, x in zip(to[bad].tolist(), parts)])] = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        return piece, np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(starts)))))

    def units(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The texts, each with a space before it, cut before every space and between characters that lie side by side in no
        piece, as nothing is merged across such a border; and where each text's units begin. Empty texts have none."""
        some = pc.binary_length(texts).to_numpy() > 0
        texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.filter(pa.array(some)), pa.scalar(" ", pa.large_string()))
        sizes = pc.binary_length(texts).to_numpy()
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: sizes.sum()] if len(texts) else np.zeros(0, np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # bytes of a character
        codes = self.code[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        here = np.flatnonzero(np.bincount(codes, minlength=1))
        to = np.zeros(0x10000, np.uint16)
        to[here] = np.arange(1, len(here) + 1)
        together = np.zeros((len(here) + 1, len(here) + 1), bool)
        left, right = to[self.beside >> np.uint32(16)], to[self.beside & np.uint32(0xFFFF)]
        together[left, right] = (left > 0) & (right > 0)
        together[:, to[self.code[0x20]]] = False
        codes = to[codes]
        border = np.r_[True, ~together[codes[:-1], codes[1:]]] if len(codes) else np.zeros(0, bool)
        del codes
        begin = first[border].astype(np.int64)
        whole = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)])
        each = np.zeros(len(some), np.int64)
        each[some] = sizes
        return whole.dictionary_encode(), np.searchsorted(begin, np.concatenate(([0], np.cumsum(each))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's begin. Null is empty."""
        coded, at = self.units(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " "))
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED or len(self.store) > 16 * REMEMBERED:
            self.forget()
        self.learn([x for x in distinct if x not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        begin, count = self.ends[number].astype(np.int32), (self.ends[number + 1] - self.ends[number]).astype(np.int32)
        unit = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(count[unit], dtype=np.int64)))
        source = np.repeat(begin[unit] - ends[:-1].astype(np.int32), count[unit])
        source += np.arange(ends[-1], dtype=np.int32)
        return self._joined(self.store[source], ends[at])

    def run_of_marks(self, n: int) -> list[int]:
        """The lengths that n space marks are merged to: the leftmost pair that is a piece is always the next."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def _joined(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single space marks, which the words have left, become longer pieces."""
        single = ids == self.runs[1]
        begin = np.zeros(len(ids) + 1, bool)
        begin[at] = True
        opens = single & ~np.r_[False, single[:-1] & ~begin[1:-1]] if len(ids) else single
        firsts = np.flatnonzero(opens)
        size = np.bincount(np.cumsum(opens)[single] - 1, minlength=len(firsts))
        drop, known = np.zeros(len(ids), bool), {}
        if not (size > 1).any():
            return ids, at
        for first, n in zip(firsts[size > 1].tolist(), size[size > 1].tolist()):
            if n not in known:
                known[n] = [self.runs[k] for k in self.run_of_marks(n)]
            ids[first : first + len(known[n])] = known[n]
            drop[first + len(known[n]) : first + n] = True
        kept = np.concatenate(([0], np.cumsum(~drop)))
        return ids[~drop], kept[at]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of all ids: the bytes of their pieces, without the space that a text's first piece begins with."""
        size = np.diff(self.bytes_at).astype(np.int32)[ids]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        source = np.repeat(self.bytes_at.astype(np.int32)[ids] - ends[:-1].astype(np.int32), size)
        source += np.arange(ends[-1], dtype=np.int32)
        data, ends = self.bytes_of[source], ends[at]
        del source
        some = np.flatnonzero(np.diff(ends) > 0)
        stays = np.ones(len(data), bool)
        stays[ends[:-1][some]] = False
        ends = ends - np.searchsorted(some, np.arange(len(ends)))
        out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[stays])])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text has
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of so many bits to numbers, 64 bits of them to each, the first the most significant."""
    n = 64 // bits
    c = codes.reshape(len(codes), codes.shape[1] // n, n).astype(np.uint64)
    out = np.zeros(c.shape[:2], np.uint64)
    for k in range(n):
        out |= c[:, :, k] << np.uint64(64 - bits * (k + 1))
    return out


def _windows(codes: np.ndarray, places: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The packed codes of the next width characters at each place."""
    n = 64 // bits
    codes = np.concatenate((codes, np.zeros(width, np.uint16))).astype(np.uint64)
    at = np.zeros(len(codes), np.uint64)
    for k in range(n):
        at[: len(codes) - k] |= codes[k:] << np.uint64(64 - bits * (k + 1))
    return np.stack([at[places + k] for k in range(0, width, n)], axis=1)


def _search(keys: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search for all rows of want at once: how many sorted keys are less (after: or equal)."""
    low, high = np.zeros(len(want), np.int64), np.full(len(want), len(keys))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        got = keys[np.minimum(mid, max(0, len(keys) - 1))]
        less, equal = np.zeros(len(want), bool), np.ones(len(want), bool)
        for k in range(want.shape[1]):
            less |= equal & (got[:, k] < want[:, k])
            equal &= got[:, k] == want[:, k]
        down = (less | equal if after else less) & open_
        low = np.where(down, mid + 1, low)
        high = np.where(open_ & ~down, mid, high)
    return low


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


RESULTS = ("ids", "n_ids", "decoded", "round_trip")


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with ids, n_ids, decoded (of the ids) and round_trip (decoded is the text). tokenizer: a file that every executor has."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("given"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([docs.schema["given"], *T.StructType.fromDDL("ids array<int>, n_ids long, decoded string, round_trip boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(tokenizer)
        for batch in batches:
            for start, n in slices(batch.column(1), SLICE):
                given, texts = batch.slice(start, n).columns
                ids, at = own.encode(texts)
                decoded = own.decoded(ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([given, lists, pa.array(np.diff(at)), decoded, pc.equal(texts.cast(pa.string()), decoded)], names=["given", *RESULTS])

    return docs.mapInArrow(run, schema).select(*[F.col("given")[c].alias(c) for c in names], *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids", "n_ids", "round_trip")
