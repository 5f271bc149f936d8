"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is read as eight (position, byte) terms. Two fingerprints
within three bits differ in at most three bytes, so they share at least five
terms. Postings are keyed by three terms, all from one half of the fingerprint:
of five shared terms one half holds three, so eight keys a fingerprint lose no
pair. For each pair met in a posting, the shared terms are tallied on the pair in hand,
which takes no shuffle of hits; the pairs that reach five, the guaranteed minimum, are
verified by the bits that differ. The tally spares verifications and can lose no link.

Long postings are re-keyed by five terms, the guaranteed minimum itself, and
what is still long is compared in blocks that yield a spanning forest and never
all the pairs. Equal fingerprints are one entry from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, unused
from .components import connected_components, star_edges

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at once; bounds the memory that one long text takes.
_STEP = 1 << 16


def fingerprint(text: str | None, seed: int = SEED) -> int:
    """The 64-bit SimHash of the 3-word shingles; no words (or null) gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words), b"", b""]
        shingles = 1
    else:
        shingles = len(words) - 2
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, shingles, _STEP):
        part = words[at : min(at + _STEP, shingles) + 2]
        grams = map(b" ".join, zip(part, part[1:], part[2:])) if words[-1] else [words[0]]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > shingles).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            made = np.fromiter((fingerprint(text[i].as_py(), seed) for i in range(b.num_rows)), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made.view(np.int64))], names)

    return run


def with_fingerprints(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """The ``carry`` columns and ``_fp``, the fingerprint as a signed long; a column of that name is left out."""
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != "_fp"]
    src = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias(unused(carry, "_text")[0]))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["_fp long"])
    return src.mapInArrow(_fingerprints(seed, [*carry, "_fp"]), kinds)


_HALVES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
_FIVES = list(combinations(range(8), 5))


def _term(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _key(fp: Column, number: int, places: tuple[int, ...]) -> Column:
    out = F.lit(number).cast("long")
    for p in places:
        out = F.shiftleft(out, 8).bitwiseOR(_term(fp, p))
    return out


def _tally(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    return sum(((_term(a, i) == _term(b, i)).cast("int") for i in range(1, 8)), (_term(a, 0) == _term(b, 0)).cast("int"))


def _postings(nodes: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    """(pkey, fp, rep, n): the entries of every posting that holds two entries or more."""
    made = nodes.select(
        F.explode(F.array(*[_key(F.col("fp"), i, k) for i, k in enumerate(keys)])).alias("pkey"), "fp", "rep"
    )
    size = made.groupBy("pkey").agg(F.count("*").alias("n")).where("n > 1")
    return made.join(size, "pkey")


def _short(postings: DataFrame, shared: int, max_bits: int) -> DataFrame:
    a = postings.select("pkey", F.col("fp").alias("fa"), F.col("rep").alias("src"))
    b = postings.select("pkey", F.col("fp").alias("fb"), F.col("rep").alias("dst"))
    near = (_tally(F.col("fa"), F.col("fb")) >= shared) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    return a.join(b, (a["pkey"] == b["pkey"]) & (F.col("fa") < F.col("fb")) & near).select("src", "dst")


def _tile(shared: int, max_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, rep, side = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        a, b = [rep[:0]], [rep[:0]]
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            x = fp[rows][:, None] ^ fp[right][None, :]
            i, j = np.nonzero(np.bitwise_count(x) <= max_bits)
            enough = (x[i, j][:, None].view(np.uint8).reshape(-1, 8) == 0).sum(1) >= shared
            tree = star_edges(rep[rows[i[enough]]], rep[right[j[enough]]])  # at most one link a node from each stripe
            a.append(tree[0])
            b.append(tree[1])
        node, root = star_edges(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"src": node, "dst": root}).astype("int64")

    return run


def _long(postings: DataFrame, shared: int, max_bits: int, block: int) -> DataFrame:
    """Compare long postings in tiles of ``block`` by ``block`` entries."""
    cut = postings.withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    )
    one = cut.select("*", F.explode(F.expr("sequence(part, k - 1)")).alias("other")).select(
        "pkey", F.col("part").alias("i"), F.col("other").alias("j"), "fp", "rep", F.lit(0).alias("side")
    )
    two = (
        cut.where("k > 1 and part > 0")
        .select("*", F.explode(F.expr("sequence(0, part - 1)")).alias("other"))
        .select("pkey", F.col("other").alias("i"), F.col("part").alias("j"), "fp", "rep", F.lit(1).alias("side"))
    )
    return one.unionByName(two).groupBy("pkey", "i", "j").applyInPandas(_tile(shared, max_bits), "src long, dst long")


def links(nodes: DataFrame, max_bits: int = 3, short: int = 32, block: int = 2048) -> DataFrame:
    """(src, dst) links that join every pair of entries within ``max_bits`` bits, directly
    or by a chain of links. ``nodes``: distinct fingerprints ``fp`` (long) with a name ``rep``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees pairs of up to three differing bits")
    shared = 8 - max_bits
    first = save(_postings(nodes, _HALVES), "postings")
    out = _short(first.where(f"n <= {short}"), shared, max_bits)
    hot = first.where(f"n > {short}").select("fp", "rep").distinct()
    second = save(_postings(hot, _FIVES), "postings5")
    return out.unionByName(_short(second.where(f"n <= {short}"), shared, max_bits)).unionByName(
        _long(second.where(f"n > {short}"), shared, max_bits, block)
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, seed: int = SEED) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``.

    ``component_id`` is the smallest id reachable by links of at most ``max_bits``
    differing bits; ``kept`` marks the row whose id that is. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null id take part in nothing:
    null component, kept. Rows that repeat an id keep their own fingerprints; each
    joins the component of its fingerprint. Texts of any length are taken whole, their shingles in
    steps; no rows: no rows. Other columns are ignored.
    """
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    prints = save(with_fingerprints(src, "_text", ["_id"], seed), "fingerprints")
    nodes = save(
        prints.where("_id is not null").groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("rep")), "entries"
    )
    found = connected_components(links(nodes, max_bits))
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    out = prints.join(named, "_fp", "left")
    component = F.when(F.col("_id").isNotNull(), F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
