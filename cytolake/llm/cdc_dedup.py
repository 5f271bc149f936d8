"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text whose blanks are single spaces; the
sixteen bytes before a word's end decide whether a chunk ends there, so chunks
depend on their own words and an insertion moves no later boundary. Chunks are
deduplicated by digest: all but the first occurrence are repeats. A run of
repeats of at least ``min_words`` words is a repeated passage and is cut.

With a boundary after every sixth word on average, a repeated passage loses
about three words of window and five of a partial chunk at its head, and as many
of a partial chunk at its end. What that leaves of a passage is known from its own
words: where a window of ``passage`` words holds no run of ``min_words`` between its
own first and last boundary, the window is digested as a whole as well, wherever it
stands. So every passage of at least ``passage`` words that comes again is found, by
its chunks or by its windows; its edges up to a boundary may stay in the first case.

No text is cut for one 64-bit digest that happens to be equal: a run has two chunks or
more, or its one chunk has a second digest of another seed that must be repeated too;
a window has a chunk inside that must be repeated, or a second digest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, unused


@dataclass(frozen=True)
class Chunking:
    """mean_words: words between boundaries on average; max_words: a longer chunk is cut there;
    min_words: words in a run of repeats from which it counts as a repeated passage;
    passage: words from which no repeated passage is lost."""

    mean_words: int = 6
    max_words: int = 64
    min_words: int = 25
    passage: int = 51
    seed: int = 7


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_GEARS: dict[int, np.ndarray] = {}


def gear(seed: int) -> np.ndarray:
    """A 32-bit number for each byte value, from a hash of the value."""
    if seed not in _GEARS:
        _GEARS[seed] = np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], dtype=np.uint32)
    return _GEARS[seed]


def rolling(data: np.ndarray, seed: int) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[data[i]], whose low 16 bits see 16 bytes: by doubling, all positions at once."""
    h = gear(seed)[data]
    for s in (1, 2, 4, 8):
        t = h.copy()
        t[s:] += h[:-s] << np.uint32(s)
        h = t
    return h & np.uint32(0xFFFF)


@dataclass
class Chunks:
    start: np.ndarray  # byte of the first word
    end: np.ndarray  # byte after the last word
    follow: np.ndarray  # byte of the next word
    words: np.ndarray
    digest: np.ndarray  # signed 64-bit
    first: np.ndarray  # byte of each word
    last: np.ndarray  # byte after each word
    window: np.ndarray  # first word of each window that its chunks would lose
    window_digest: np.ndarray  # signed 64-bit
    inner: np.ndarray  # a chunk inside each window whose ends are the window's own, -1 for none
    twin: dict[int, int]  # second digest of each chunk that is long enough to be a run of its own
    window_twin: dict[int, int]  # second digest of each window without a chunk inside

    def digests(self) -> np.ndarray:
        """All digests, each once."""
        more = np.array([*self.twin.values(), *self.window_twin.values()], dtype=np.int64)
        return np.unique(np.concatenate([self.digest, self.window_digest, more]))


def lost_windows(begin: np.ndarray, end: np.ndarray, natural: np.ndarray, how: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of windows, words that end at their first and at their last own boundary): the windows of ``passage``
    words with fewer than ``min_words`` between the first and the last boundary that their own bytes decide, which are
    those that no copy of the window can lack.

    ``begin`` and ``end``: bytes of each word in the text of single blanks; ``natural``: words whose hash ends a chunk."""
    n = len(begin) - how.passage + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    at = np.concatenate([[-1], natural, [len(begin) + how.passage]])
    own = np.searchsorted(end, begin[:n] + 16)  # the first word whose hash sees no byte before the window
    lo = at[np.searchsorted(at, own)]
    hi = at[np.searchsorted(at, np.arange(n) + how.passage) - 1]
    lost = np.flatnonzero(hi - lo < how.min_words)
    return lost, lo[lost], hi[lost]


def _hashed(text: bytes, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """The digests of pieces of a text, as signed longs."""
    made = (xxhash.xxh3_64_intdigest(text[i:j], seed) for i, j in zip(lo.tolist(), hi.tolist(), strict=True))
    return np.fromiter(made, dtype=np.uint64, count=len(lo)).view(np.int64)


def chunk(raw: bytes, how: Chunking) -> Chunks | None:
    """The chunks of a text's UTF-8 bytes; None without a word."""
    a = np.frombuffer(raw, dtype=np.uint8)
    blank = _BLANK[a]
    if blank.all():
        return None
    before = np.concatenate([[True], blank[:-1]])
    after = np.concatenate([blank[1:], [True]])
    first = np.flatnonzero(~blank & before)
    last = np.flatnonzero(~blank & after) + 1
    data = np.where(blank, np.uint8(32), a)[~blank | ~before]
    ends = np.cumsum(last - first + 1) - 1
    cut = rolling(data, how.seed)[ends - 1] < 65536 // how.mean_words
    natural = np.flatnonzero(cut)
    cut[-1] = True
    at = np.flatnonzero(cut)
    gaps = np.diff(at, prepend=-1)
    if (gaps > how.max_words).any():
        more = [np.arange(a0 - g + how.max_words, a0, how.max_words) for a0, g in zip(at, gaps, strict=True) if g > how.max_words]
        at = np.unique(np.concatenate([at, *more]))
    begin = np.concatenate([[0], at[:-1] + 1])
    text = data.tobytes()
    words = at - begin + 1
    word = ends - (last - first)
    lo, hi = word[begin], ends[at]
    alone = np.flatnonzero(words >= how.min_words)
    twin = dict(zip(alone.tolist(), _hashed(text, lo[alone], hi[alone], how.seed + 1).tolist(), strict=True))
    window, low, high = lost_windows(word, ends, natural, how)
    inner = np.minimum(np.searchsorted(begin, low + 1), len(begin) - 1)
    inner = np.where((begin[inner] == low + 1) & (at[inner] <= high), inner, -1)
    start, stop = word[window], ends[window + how.passage - 1]
    bare = np.flatnonzero(inner < 0)
    window_twin = dict(zip(bare.tolist(), _hashed(text, start[bare], stop[bare], how.seed + 2).tolist(), strict=True))
    return Chunks(
        first[begin], last[at], np.concatenate([first[at[:-1] + 1], [len(raw)]]), words, _hashed(text, lo, hi),
        first, last, window, _hashed(text, start, stop, how.seed), inner, twin, window_twin,
    )


def _digests(how: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = []
            for i in range(b.num_rows):
                c = chunk((b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"), how)
                made.append(c.digests() if c is not None else np.empty(0, np.int64))
            sizes = np.cumsum([0, *map(len, made)]).astype(np.int32)
            flat = pa.array(np.concatenate(made) if made else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat)], ["_id", "_digests"])

    return run


def runs(c: Chunks, doc: int | None, earlier: dict[int, int], how: Chunking) -> list[tuple[int, int, int, int, int]]:
    """(start, end, follow, words, first document) of each run of repeats that is long enough.

    A chunk is a repeat if its digest is in ``earlier``, digests of documents of smaller id with the
    smallest of them, or has come before in the document itself, and so is its second digest if it has
    one. So is a window, unless it overlaps its copy; one that runs of chunks hold at most in part is
    joined with what it touches."""
    digests, out, n, k, at = c.digest.tolist(), [], len(c.digest), 0, 0
    own: set[int] = set()

    def again(j: int) -> bool:
        return all(d is None or d in earlier or d in own for d in (digests[j], c.twin.get(j)))

    def note(j: int) -> int:
        own.update((digests[j], c.twin.get(j, digests[j])))
        return int(c.words[j])

    while k < n:
        j, words, seen = k, 0, Counter()
        while j < n and again(j):
            words += note(j)
            seen[earlier.get(digests[j], doc)] += 1
            j += 1
        if words >= how.min_words:
            out.append((at, at + words, seen))
        if j < n:
            words += note(j)
        at += words
        k = j + 1
    out = _with_windows(out, c, doc, earlier, how) if len(c.window) else out
    follow = lambda stop: int(c.first[stop]) if stop < len(c.first) else int(c.follow[-1])
    return [
        (int(c.first[a]), int(c.last[b - 1]), follow(b), b - a, min(seen, key=lambda d: (-seen[d], d))) for a, b, seen in out
    ]


def _with_windows(found: list, c: Chunks, doc: int | None, earlier: dict[int, int], how: Chunking) -> list:
    """``found``, (first word, word after the last, Counter of first documents), and the repeated windows that it misses."""
    own: dict[int, int] = {}
    missed, k = [], 0
    digests, times = np.unique(c.digest, return_counts=True)
    twice = set(digests[times > 1].tolist())
    for i, (a, digest, inner) in enumerate(zip(c.window.tolist(), c.window_digest.tolist(), c.inner.tolist(), strict=True)):
        b = a + how.passage
        first = earlier.get(digest)
        if first is None and own.setdefault(digest, a) + how.passage > a:
            continue
        if inner >= 0:
            sure = int(c.digest[inner]) in (twice if first is None else earlier) or int(c.digest[inner]) in twice
        else:
            second = c.window_twin[i]
            sure = second in earlier if first is not None else own.setdefault(second, a) + how.passage <= a
        if not sure:
            continue
        while k < len(found) and found[k][1] <= a:
            k += 1
        held, j = 0, k
        while j < len(found) and found[j][0] < b:
            held += min(b, found[j][1]) - max(a, found[j][0])
            j += 1
        if held < how.min_words:
            missed.append((a, b, Counter([doc if first is None else first])))
    if not missed:
        return found
    out: list = []
    for a, b, seen in sorted([*found, *missed], key=lambda x: x[:2]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + seen)
        else:
            out.append((a, b, seen))
    return out


def _found(doc: int | None, text: str | None, repeated: list | None, how: Chunking):
    raw = (text or "").encode("utf-8", "surrogatepass")
    if doc is None or (c := chunk(raw, how)) is None:
        return raw, []
    return raw, runs(c, doc, {r["digest"]: r["first"] for r in repeated or ()}, how)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking | None = None) -> DataFrame:
    """(_id, _repeats): for each document that shares a chunk with one of smaller id, the digests of such
    chunks and the smallest id that has each. A digest counts once a document, so it is a long and an id that
    is shuffled, and sums and minima of longs that are aggregated."""
    how = how or Chunking()
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    docs = save(src.where("_id is not null").mapInArrow(_digests(how), "_id long, _digests array<long>"), "chunks")
    chunks = docs.select("_id", F.explode("_digests").alias("digest"))
    shared = chunks.groupBy("digest").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last")
    later = chunks.join(shared.select("digest", "first"), "digest").where("_id != first")
    return later.groupBy("_id").agg(F.collect_list(F.struct("digest", "first")).alias("_repeats"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking | None = None) -> DataFrame:
    """One row per repeated passage: id, ``start`` and ``length`` in UTF-8 bytes of the text,
    ``n_words``, ``first_id`` (the document that has most of it first) and ``passage``.

    Null ids, and null, empty and blank texts, have none. Rows that repeat an id are one
    document: a passage that both hold is no repeat in either. No rows: no rows. Texts of any
    length; one text and its digests are in a task at a time. Other columns are ignored.
    """
    how = how or Chunking()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                raw, found = _found(doc, b.column(1)[i].as_py(), b.column(2)[i].as_py(), how)
                rows += [(doc, s, e - s, w, first, raw[s:e].decode("utf-8", "surrogatepass")) for s, e, _, w, first in found]
            kinds = [*[pa.int64()] * 5, pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                [id_col, "start", "length", "n_words", "first_id", "passage"],
            )

    src = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return src.join(repeats(df, id_col, text_col, how), "_id", "left").select("_id", "_text", "_repeats").mapInArrow(
        run, f"`{id_col}` long, start long, length long, n_words long, first_id long, passage string"
    )


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking | None = None) -> DataFrame:
    """The input rows and columns, ``text_col`` without its repeated passages, and ``removed_words``.

    Null texts stay null; rows with a null id stay as they are; rows that repeat an id are one
    document, as in ``spans``. Columns of any name stay, but for one that is called ``removed_words``.
    """
    how = how or Chunking()
    names = [c for c in df.columns if c.lower() != "removed_words"]
    at = [c.lower() for c in names].index(text_col.lower())
    key, found_col = unused(df.columns, "_id", "_repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, removed = [], []
            last = b.num_columns - 1
            ids = b.column(last - 1).to_pylist()
            for i in range(b.num_rows):
                t = b.column(at)[i].as_py()
                raw, found = _found(ids[i], t, b.column(last)[i].as_py(), how)
                keep, done = [], 0
                for s, _, follow, _, _ in found:
                    keep.append(raw[done:s])
                    done = follow
                text.append(t if not found else b"".join([*keep, raw[done:]]).decode("utf-8", "surrogatepass"))
                removed.append(sum(f[3] for f in found))
            cols = list(b.columns[:-2])
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64())], [*names, "removed_words"])

    src = df.select(*[F.col(f"`{c}`") for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    keyed = src.select("*", F.col(f"`{id_col}`").cast("long").alias(key))
    others = repeats(df, id_col, text_col, how).withColumnsRenamed({"_id": key, "_repeats": found_col})
    joined = keyed.join(others, key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], key, found_col).mapInArrow(run, f"{kinds}, removed_words long")
