"""Byte-level BPE by merge replay over a block of the corpus.

The distinct words of a block are laid out as one sequence of byte tokens. An
inverted index leads from each pair of neighbours, by the token that it merges
to, to the positions where it stands. Merges are replayed in rank order: each
takes its positions from the index and updates only the two neighbours that it
touches. So a word costs its merges once per block, however often it occurs.

A block is what a task reads until it knows ``KEEP_WORDS`` words. One replay over the
words of the whole corpus, which gathers them by a shuffle and sends their ids back to
the texts, was built and measured: it moves more than twice the input over disks, where
this form moves nothing and merges the rare words of a task once all the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Characters of text in a block, words kept from earlier blocks, and words of one text handled at once.
BLOCK_CHARS, KEEP_WORDS, PART_WORDS = 1 << 25, 600_000, 1 << 18
#: Words whose merges are replayed together at most.
REPLAY_WORDS = 300_000


class Bpe:
    """Encode and decode by a file of ranks: lines of a base64 token and its rank, which is its id."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.token: list[bytes] = [b""] * self.size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.split = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            self.ranks[t[:i]] * self.size + self.ranks[t[i:]]: r
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.merge = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)  # word -> its number
        self.flat, self.ends = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair of neighbours merges to, -1 for none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merge[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids end)."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        # a word that is a token needs no merge; it stands in the sequence as that token
        sizes = np.where(whole >= 0, 1, size)
        owner = np.repeat(np.arange(len(words)), sizes)
        n = len(owner)
        sym = np.empty(n, dtype=np.int64)
        sym[(whole >= 0)[owner]] = whole[whole >= 0]
        raw = np.frombuffer(b"".join(w for w, t in zip(words, whole.tolist(), strict=True) if t < 0), dtype=np.uint8)
        sym[(whole < 0)[owner]] = self.byte[raw]
        inner = np.concatenate([owner[1:] == owner[:-1], [False]])
        right = np.where(inner, np.arange(1, n + 1), -1)
        left = np.where(np.concatenate([[False], inner[:-1]]), np.arange(-1, n - 1), -1)
        alive = np.ones(n, dtype=bool)
        merges = np.full(n, -1, dtype=np.int64)  # what a position and its right neighbour merge to
        at = np.flatnonzero(inner)
        merges[at] = self._merged(sym[at], sym[at + 1])
        postings: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(rank: np.ndarray, place: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.concatenate([[0], cuts])].tolist() if len(rank) else []
            starts = [0, *cuts.tolist(), len(rank)]
            for k, r in enumerate(firsts):
                got = postings.get(r)
                if got is None:
                    postings[r] = [place[starts[k] : starts[k + 1]]]
                    heappush(heap, r)
                else:
                    got.append(place[starts[k] : starts[k + 1]])

        some = at[merges[at] >= 0]
        post(merges[some], some)
        heapify(heap)
        odd: list[np.ndarray] = []  # words where a merge opened one of lower rank: their order is their own
        while heap:
            r = heappop(heap)
            got = postings.pop(r)
            p = np.unique(np.concatenate(got)) if len(got) > 1 else got[0]
            p = p[merges[p] == r]
            if not len(p):
                continue
            if len(p) > 1 and (follows := right[p[:-1]] == p[1:]).any():
                k = np.arange(len(p))  # overlapping places: the first of each chain, the third, and so on
                p = p[(k - np.maximum.accumulate(np.where(np.concatenate([[True], ~follows]), k, 0))) % 2 == 0]
            q = right[p]
            s = right[q]
            sym[p], alive[q], merges[q], right[p] = r, False, -1, s
            has = s >= 0
            left[s[has]] = p[has]
            o = left[p]
            o = o[o >= 0]
            merges[p[~has]] = -1
            new = np.concatenate([p[has], o])
            made = self._merged(sym[new], sym[right[new]])
            merges[new] = made
            low = (made >= 0) & (made < r)
            if low.any():
                odd.append(owner[new[low]])
            more = made > r
            if more.any():
                post(made[more], new[more])
        lengths = np.bincount(owner[alive], minlength=len(words))
        ids, ends = sym[alive], np.cumsum(lengths)
        if odd:
            split = np.split(ids, ends[:-1])
            for w in np.unique(np.concatenate(odd)).tolist():
                split[w] = np.array(self.alone(words[w]), dtype=np.int64)
            ids, ends = np.concatenate(split), np.cumsum([len(x) for x in split])
        return ids, ends

    def alone(self, word: bytes) -> list[int]:
        """One word on its own: the leftmost pair of lowest rank, again and again."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((m, i) for i in range(len(parts) - 1) if (m := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [self.token[best[0]]]
        return [self.ranks[p] for p in parts]

    def number(self, text: str) -> np.ndarray:
        """The number of each word of a text; new words get new numbers."""
        if len(text) <= BLOCK_CHARS:
            words = self.split.findall(text)
            return np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words))
        words, parts = (m.group() for m in self.split.finditer(text)), []
        while part := list(islice(words, PART_WORDS)):
            parts.append(np.fromiter(map(self.index.__getitem__, part), dtype=np.int32, count=len(part)))
        return np.concatenate(parts)

    def learn(self) -> None:
        """Replay the merges over the words that have a number but no ids yet."""
        done = len(self.ends) - 1
        new = [w.encode("utf-8") for w in islice(self.index, done, None)]
        flat, ends = [self.flat], [self.ends]
        for at in range(0, len(new), REPLAY_WORDS):
            ids, stop = self.replay(new[at : at + REPLAY_WORDS])
            flat.append(ids)
            ends.append(stop + ends[-1][-1])
        self.flat, self.ends = np.concatenate(flat), np.concatenate(ends)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered words, one after another."""
        start, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.cumsum(size)
        return self.flat[np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One codec for each file in a worker, with the words that it has learned."""
    return Bpe(path, pattern)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _round_trip(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path, pattern)
        decimal = [str(i) for i in range(codec.size)]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * with_ids]
        for b in batches:
            rows = []
            column = b.column(b.num_columns - 1)
            for block in _blocks([column[i].as_py() or "" for i in range(b.num_rows)]):
                if len(codec.index) > KEEP_WORDS:
                    codec.forget()
                numbered = [codec.number(t) for t in block]
                codec.learn()
                for words in numbered:
                    n, ids_hash, back, every = 0, hashlib.sha256(), hashlib.sha256(), []
                    for at in range(0, len(words), PART_WORDS):
                        ids = codec.ids(words[at : at + PART_WORDS]).tolist()
                        ids_hash.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                        back.update(codec.decode(ids))
                        n += len(ids)
                        if with_ids:
                            every += ids
                    rows.append((n, ids_hash.hexdigest(), back.hexdigest(), *[every] * with_ids))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *names])

    return run


def encode_decode(
    df: DataFrame, ranks: str, pattern: str, text_col: str = "text", carry: list[str] | None = None, with_ids: bool = False
) -> DataFrame:
    """The ``carry`` columns (default: all), ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256`` (of the bytes that the ids decode to) and, if asked, ``ids``.

    One pass, no shuffle. Null text counts as empty, which has no ids; no rows: no rows. Rows that repeat
    get the same results. Texts of any length are taken whole, their words in parts. An input column that
    bears the name of a result column is left out; others keep theirs.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    src = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias(unused(carry, "_text")[0]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    kinds += ["n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<long>"] * with_ids]
    return src.mapInArrow(_round_trip(ranks, pattern, with_ids), ", ".join(kinds))
