"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window is a run of sequences; in each one the
round-robin gives every queue its quantum (its target share of the window) on top of the
deficit that it carries, serves whole tokens and carries the rest on. Since token
streams may be cut anywhere, a deficit stays below one token, and what a queue has
been served by the end of any window has a closed form, which tests hold against the
round-robin taken literally. So a partition needs no state from the one before it: it
knows the deficits at its first window, whichever that is, and all partitions
together fill each window to the target proportions.

A queue that runs dry ends a phase; the next one shares among the queues left. Queues
to which a phase owes less than one token a window, which no window can hold in
proportion, are served one after another as one lane.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import root_bits, save


# --- tokens -----------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as ``tokenizers`` gives them for a tokenizer file.

    Where the file is a plain byte-level BPE whose ids are in merge order, the same
    merges run in the ``tiktoken`` library, which is four times as fast; a text that
    holds the string of an added token, and any other kind of file, goes through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        vocab = model.get("vocab") or {}
        vocab = vocab if isinstance(vocab, dict) else {}
        plain = (
            model.get("type") == "BPE"
            and not spec.get("normalizer")
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        self.fast = None
        if plain:
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [vocab["".join(m)] for m in merges]
            if made == sorted(made):
                alphabet = _byte_alphabet()
                ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in self.added}
                self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = "<u2" if self.fast is not None and max(vocab.values()) < 65536 and not self.added[1:] else "<u4"

    @property
    def slow(self) -> Tokenizer:
        if self._slow is None:
            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each file in a worker."""
    return Encoder(path, pattern)


def _tokenize(path: str, pattern: str, eos: int):
    """Rows (doc, queue, text) to (doc, queue, partition, tokens of the queue before it in the partition, tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, pattern), TaskContext.get().partitionId(), {}
        names = ["_doc", "_queue", "_part", "_before", "_n", "_ids"]

        def out(doc, queue, before, counts, ids):
            n = len(ids)
            made = [pa.array([part] * n, pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays([doc.slice(0, n), queue.slice(0, n), *made], names)

        for b in batches:
            queues, text = b.column(1).to_pylist(), b.column(2)
            before, counts, ids, size, first = [], [], [], 0, 0
            for i, queue in enumerate(queues):
                made = np.array([*enc(text[i].as_py() or ""), eos], dtype=enc.width).tobytes()
                n = len(made) // int(enc.width[-1])
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + n
                counts.append(n)
                ids.append(made)
                size += len(made)
                if size > 1 << 22:
                    yield out(b.column(0).slice(first), b.column(1).slice(first), before, counts, ids)
                    before, counts, ids, size, first = [], [], [], 0, i + 1
            if ids:
                yield out(b.column(0).slice(first), b.column(1).slice(first), before, counts, ids)

    return run


# --- the round-robin --------------------------------------------------------


@dataclass(frozen=True)
class Turn:
    """A queue's part in a phase: the phase's ``start`` in the packed stream and its ``total``; what the
    queue was served ``before`` and is served in it (``own``); its lane's quanta, summed over the lanes
    ``below`` and its own (``lane``), and the queue's place in the lane (``at``)."""

    start: int
    total: int
    before: int
    own: int
    below: int
    lane: int
    at: int


TURN = "array<struct<start:bigint,total:bigint,before:bigint,own:bigint,below:bigint,lane:bigint,at:bigint>>"


def lanes(own: dict[str, int], window: int) -> dict[str, tuple[int, int, int]]:
    """(below, lane, at) of each queue of a phase that serves ``own`` tokens of it. The greatest come first; queues
    with less than one token a window share the last lane, which a lane of one token a window or more must be."""
    total = sum(own.values())
    great = sorted((q for q in own if own[q] * window >= total), key=lambda q: (-own[q], q))
    small = sorted(q for q in own if own[q] * window < total)
    rest = sum(own[q] for q in small)
    out, below = {}, 0
    for q in great:
        out[q] = (below, own[q], 0)
        below += own[q]
    low, lane, at = below, rest, 0
    if small and rest * window < total:
        low, lane, at = out[great[-1]][0], own[great[-1]] + rest, own[great[-1]]
        out[great[-1]] = (low, lane, 0)
    for q in small:
        out[q] = (low, lane, at)
        at += own[q]
    return out


def turns(totals: dict[str, int], weights: dict[str, float], window: int, start: int = 0) -> dict[str, list[Turn]]:
    """Each queue's turns until all queues are empty, each of which has a weight above 0."""
    left, out, served, at = {q: n for q, n in totals.items() if n}, {q: [] for q in totals}, dict.fromkeys(totals, 0), start
    while left:
        dry = min(left, key=lambda q: (left[q] / weights[q], q))
        own = {q: left[q] if q == dry else min(left[q], int(weights[q] * left[dry] / weights[dry])) for q in left}
        own = {q: n for q, n in own.items() if n}
        total = sum(own.values())
        for q, lane in lanes(own, window).items():
            out[q].append(Turn(at, total, served[q], own[q], *lane))
        at += total
        for q, n in own.items():
            served[q] += n
            left[q] -= n
        left = {q: n for q, n in left.items() if n}
    return out


def pieces(own_turns: list[Turn], first: int, n: int, length: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(start in the queue, tokens, place in the packed stream) of tokens ``first`` to ``first + n`` of a queue.

    At x tokens into a phase, a lane has been served ``x * (below + lane) // total - x * below // total``: its
    quantum times x, within one token, and all lanes sum to x. With one token a window or more it never falls.
    """
    end = first + n
    for t in own_turns:
        if end <= t.before or first >= t.before + t.own:
            continue
        low, high, total, shift = t.below, t.below + t.lane, t.total, t.at - t.before
        p, stop = max(first, t.before) + shift, min(end, t.before + t.own) + shift
        w = max(0, p * total // t.lane // window - 1)
        while p < stop:
            x0, x1 = min(w * window, total), min((w + 1) * window, total)
            low0, low1 = x0 * low // total, x1 * low // total
            a0, a1 = x0 * high // total - low0, x1 * high // total - low1
            if a1 <= p:
                w += 1
                continue
            place = t.start + x0 + (low1 - low0) + (p - a0)
            take = min(stop - p, a1 - p, length - place % length)
            yield p - shift, take, place
            p += take


def _cut(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for b in batches:
            rows = []
            raws = b.column(4)
            for k, (doc, source, first, n, own) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True)):
                raw = raws[k].as_py()
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                for at, take, place in pieces([Turn(**t) for t in own], first, n, length, window):
                    i = at - first
                    rows.append((doc, source, i, take, n, place // length, place % length, ids[i : i + take].tobytes()))
                    if len(rows) >= 4000:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)

    return run


def _natural(totals: DataFrame, start: int, window: int) -> DataFrame:
    """(_q, turns) of queues that share by their sizes, so in one phase, with the lanes of ``lanes``. A phase has at most
    ``window`` lanes, which one task sums up; the queues of the last lane are summed up in two levels."""
    size = totals.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    bound = -(-size // window)
    small, great = totals.where(F.col("_n") < bound), totals.where(F.col("_n") >= bound)
    rest = small.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    before = Window.orderBy(F.desc("_n"), "_q").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("_n"), "_q").rowsBetween(1, Window.unboundedFollowing)
    own = great.select("_q", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("below"), F.count("*").over(after).alias("_after"))
    joined = bool(rest["n"]) and rest["n"] * window < size  # the rest is less than a token a window itself
    lane = F.col("_n") + F.when(F.col("_after") == 0, F.lit(rest["n"])).otherwise(F.lit(0)) if joined else F.col("_n")
    out = own.select("_q", "_n", "below", lane.alias("lane"), F.lit(0).cast("long").alias("at"))
    if rest["c"]:
        last = out.orderBy(F.desc("below")).first() if joined else None
        low, width, shift = (last["below"], last["lane"], last["_n"]) if joined else (size - rest["n"], rest["n"], 0)
        bits = root_bits(rest["c"])
        hashed = small.withColumn("_h", F.xxhash64("_q")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
        inside = Window.partitionBy("_b").orderBy("_h", "_q").rowsBetween(Window.unboundedPreceding, -1)
        sums = hashed.groupBy("_b").agg(F.sum("_n").alias("_s"))
        earlier = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        at = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + shift
        chained = hashed.join(earlier, "_b").select("_q", "_n", F.lit(low).cast("long").alias("below"), F.lit(width).cast("long").alias("lane"), at.alias("at"))
        out = out.unionByName(chained)
    turn = F.struct(F.lit(start).cast("long").alias("start"), F.lit(size).cast("long").alias("total"), F.lit(0).cast("long").alias("before"), F.col("_n").alias("own"), "below", "lane", "at")
    return out.select("_q", F.array(turn).cast(TURN).alias("turns"))


def _schedule(totals: DataFrame, weights: dict[str | None, float], window: int) -> DataFrame:
    """(_q, turns) of every queue. ``weights`` is given by the caller, so what is worked out on the driver is bounded by
    it; all other queues come after those with a weight, in shares by their sizes."""
    spark = totals.sparkSession
    given = {("null" if k is None else f"={k}"): float(v) for k, v in weights.items() if v > 0}
    if not given:
        return _natural(totals, 0, window)
    names = F.broadcast(spark.createDataFrame([(q,) for q in given], "_q string"))  # as many rows as weights are given
    sizes = {r["_q"]: r["_n"] for r in totals.join(names, "_q").collect()}
    rows = [(q, [vars(t) for t in ts]) for q, ts in turns(sizes, given, window).items()]
    made = spark.createDataFrame(rows, f"_q string, turns {TURN}")
    return _natural(totals.join(names, "_q", "left_anti"), sum(sizes.values()), window).unionByName(made)


def pack(
    df: DataFrame,
    tokenizer: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: int = 1024,
    window_sequences: int = 64,
    weights: dict[str | None, float] | None = None,
    eos: int = 0,
) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, doc_tokens, sequence_id, offset,
    and ``ids`` (little-endian unsigned 32-bit).

    A document is its ids and then ``eos``; null and empty texts are the ``eos`` alone.
    Each id lies in one piece; all sequences but the last are full, so at most
    ``length - 1`` tokens of padding are needed in all. ``weights``: target proportions
    by source (default: the sources' shares); sources without a weight, or with 0, come after
    the others by their shares. Null sources are one queue of their own. Any number of
    sources is taken, each by its own name; those owed less than one token in a window
    are served one after another in a lane of their own.
    Rows that repeat an id are documents of their own. In a queue documents follow the table.
    Texts of any length: a task holds one text's ids at a time. No rows: no pieces. Other
    columns are ignored.

    The ids are written once and never shuffled: a partition's rows know what came before them in
    it, and the table of (queue, partition) totals is joined to them, by broadcast where its files
    are below the engine's limit for that.
    """
    src = df.select(
        F.col(f"`{id_col}`").cast("long").alias("_doc"),
        F.col(f"`{source_col}`").cast("string").alias("_queue"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
    )
    kinds = "_doc long, _queue string, _part long, _before long, _n long, _ids binary"
    window = length * window_sequences
    tokens = save(src.mapInArrow(_tokenize(tokenizer, pattern, eos), kinds), "tokens")
    named = tokens.withColumn("_q", F.coalesce(F.concat(F.lit("="), "_queue"), F.lit("null")))
    sizes = save(named.groupBy("_q", "_part").agg(F.sum("_n").alias("_n")), "sizes")
    schedule = _schedule(sizes.groupBy("_q").agg(F.sum("_n").alias("_n")), weights or {}, window)
    earlier = Window.partitionBy("_q").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_q", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    places = save(bases.join(schedule, "_q"), "places")
    return (
        named.join(places, ["_q", "_part"])
        .select("_doc", "_queue", (F.col("_base") + F.col("_before")).alias("_first"), "_n", "_ids", "turns")
        .mapInArrow(
            _cut(length, window),
            "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )
