"""Token counts from pre-token frequencies, without materialising ids.

In each slice of a task's texts, the distinct pre-tokens are a table with the pieces of each, counted once; the documents' pre-tokens are a
table of frequencies (document, pre-token, n). Their join gives n times the pieces, which is summed per document; no document's ids
are made. The join stays within the slice: there are nearly as many frequencies as words, and shuffling those of a
whole corpus would move more than the texts. Counts of recent pre-tokens stay in a bounded table of the worker.

A text with a special string of the tokenizer goes through the library whole, as do tokenizers whose steps this module
doesn't split at. Null and empty texts have no bytes and no tokens; each row is counted alone, so repeated rows,
null ids and empty tables need nothing special. Other columns pass through unless their names are those of the results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import small_batches, table
from weblathe.llm.jaccard_join import slices

LIMIT = 2048
#: Characters whose lower case depends on their neighbours, or on which libraries disagree.
UNLIKE = regex.compile(r"[\u03a3\u0130\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u180e\u200b-\u200f\ufeff]|[^\x00-\u2fff]")
SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
#: Pre-tokens whose counts a worker keeps at most.
REMEMBERED = 400_000
#: Characters of text that are counted at a time.
SLICE = 2_000_000


class Counter:
    """Counts tokens of texts as tokenizers' Tokenizer.from_file(path) does, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = self._splitter(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for x, i in spec["model"]["vocab"].items() if suffix and x.endswith(suffix)]] = True
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.quick = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1] == SPACES
        self.known: dict[str, int] = {}

    def _splitter(self, spec: dict):
        """The pattern of the pre-tokens, if the tokenizer finds a pattern, maps bytes and marks ends of words only."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or any(x["normalized"] for x in spec["added_tokens"]):
            return None
        first, second = steps
        if not spec["model"].get("end_of_word_suffix"):
            return None
        plain = (first["behavior"], first["invert"]) == ("Removed", True) and not second["use_regex"] and not second["add_prefix_space"]
        return regex.compile(first["pattern"]["Regex"]) if plain and "Regex" in first["pattern"] else None

    def normalised(self, text: str) -> str:
        """As the library does, up to white space; by it where Python's lower case or white space may differ."""
        if self.quick and not UNLIKE.search(text):
            return unicodedata.normalize("NFC", text).lower()
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each distinct pre-token; they are normalised already, and normalising again changes nothing."""
        new = [x for x in tokens if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = tokens
        # Pre-tokens with blanks between them are split at the blanks again, so that many are encoded as one text.
        groups = [new[at : at + 2000] for at in range(0, len(new), 2000)]
        for part, got in zip(groups, self.whole.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False)):
            last = np.flatnonzero(self.ends[np.array(got.ids, np.int64)])
            self.known.update(zip(part, np.diff(last, prepend=-1).tolist(), strict=True))
        return np.fromiter((self.known[x] for x in tokens), np.int64, len(tokens))

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = []
        for i, x in enumerate(texts):
            if self.split is None or any(s in x for s in self.special):
                out[i] = len(self.whole.encode(x, add_special_tokens=False))
            elif x:
                plain.append(i)
        found = [self.split.findall(self.normalised(texts[i])) for i in plain]
        if found:
            each = np.fromiter(map(len, found), np.int64, len(found))
            coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
            size = max(1, len(coded.dictionary))
            # how often each document has each pre-token, joined to the pieces of the pre-tokens
            pairs, often = np.unique(np.repeat(np.arange(len(found)), each) * size + coded.indices.to_numpy(), return_counts=True)
            document, token = np.divmod(pairs, size)
            out[plain] = np.bincount(document, often * self.pieces(coded.dictionary.to_pylist())[token], len(found))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


RESULTS = ("n_bytes", "n_tokens", "over_limit")


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs, without text, with n_bytes, n_tokens and over_limit. tokenizer: a file that every executor has at this path."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("given"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([docs.schema["given"], *T.StructType.fromDDL("n_bytes long, n_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for start, n in slices(batch.column(1), SLICE):
                given, texts = batch.slice(start, n).columns
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([given, pa.array(sizes), pa.array(own.counts(texts.to_pylist()))], names=["given", "n_bytes", "n_tokens"])

    made = docs.mapInArrow(run, schema)
    return made.select(*[F.col("given")[c].alias(c) for c in names], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
