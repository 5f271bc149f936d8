"""Token counts with a shortcut for whole tokens.

A text is cut into pre-tokens, and each is merged on its own. For a vocabulary it can be
proved beforehand which strings are one pre-token and are merged to one token; in a text
they count as one without any merging. The proof takes each string of the vocabulary once,
so it costs nothing with the corpus; what is left of a text, a few words in a hundred, is merged.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .packing import _byte_alphabet

#: Characters of a text from which its pre-tokens are counted in pieces, and pre-tokens in a piece: bounds memory only.
LONG, PIECE = 1 << 20, 1 << 16
#: Merged strings that a worker keeps the counts of; beyond it they are forgotten, and merged again when they return.
MEMO = 200_000


class Counts:
    """Counts as the ``tokenizers`` library has them for a byte-level BPE file, its added tokens found first wherever they stand."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        added = spec.get("added_tokens") or []
        if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        alphabet = _byte_alphabet()
        names = sorted((a["content"] for a in added), key=len, reverse=True)  # the longest of those that start at a place
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        vocab = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["vocab"].items() if t not in names}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if (made := [model["vocab"]["".join(p)] for p in pairs]) != sorted(made):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.pattern = regex.compile(pattern)
        self.merges = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        self.known: dict[str, int] = dict.fromkeys(self.proved(vocab), 1)
        self.proven = len(self.known)

    def proved(self, vocab: dict[bytes, int]) -> Iterator[str]:
        """The strings of the vocabulary that are one pre-token, and that their merges make one token of."""
        for token, i in vocab.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:  # a piece of a character is no pre-token
                continue
            if self.pattern.findall(text) == [text] and self.merges.encode_ordinary(text) == [i]:
                yield text

    def _plain(self, text: str) -> int:
        """Of a text without added tokens."""
        if len(text) < LONG:
            return self._of(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        n = 0
        while piece := list(islice(found, PIECE)):
            n += self._of(piece)
        return n

    def _of(self, words: list[str]) -> int:
        known = self.known
        counts = list(map(known.get, words))
        n = sum(filter(None, counts))
        rest = Counter(w for w, c in zip(words, counts, strict=True) if c is None)
        if len(known) + len(rest) > self.proven + MEMO:
            for w in list(islice(reversed(known), len(known) - self.proven)):
                del known[w]
        for w, times in rest.items():
            own = len(self.merges.encode_ordinary(w))  # a pre-token is one when alone, too
            n += own * times
            if len(w) <= 64 and len(known) < self.proven + MEMO:
                known[w] = own
        return n

    def __call__(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        n, at = 0, 0
        for m in self.added.finditer(text):
            n += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self._plain(text[at:])


@lru_cache(maxsize=2)
def counts(path: str, pattern: str) -> Counts:
    """One table for each file in a worker."""
    return Counts(path, pattern)


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path, pattern)
        for b in slices(batches):
            text = b.column(1)
            n = [own(text[i].as_py() or "") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``, whether the tokens are more than ``limit``.

    Null and empty texts have no bytes and no tokens. A text of any length is counted whole. Rows that repeat an id, or have
    none, are counted on their own. No rows: no rows. Other columns are ignored, whatever their names."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_count(path, pattern), f"id {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
