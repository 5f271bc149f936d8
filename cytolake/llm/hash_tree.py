"""Sharding by a hierarchical weighted hash tree.

A row descends from regions to racks to shards. At each level every child draws
-ln(u) / weight, with u a hash of the row's key and the child's name, and the
smallest draw wins: a child gets rows in proportion to its weight, and when a
weight changes, only rows of the subtree whose weight changed move into or out of
it; draws inside every other subtree stay as they are.

``Tree.grown`` adds a shard as a region of its own, so that the rows that the new
weight attracts have nowhere to go but the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import root_bits, unsigned32

#: Hexadecimal digits of an MD5 that a draw uses: 52 bits, which a double holds.
_DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """regions: for each region its racks, for each rack its (shard, weight) pairs."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def balanced(cls, regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
        """Equal weights, shards numbered from 0 in order."""
        n = iter(range(regions * racks * shards))
        return cls(tuple(tuple(tuple((next(n), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    @property
    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, numbered after the others, in a region of its own."""
        return Tree((*self.regions, (((max(self.shards, default=-1) + 1, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _unit(key: Column, name: str) -> Column:
    """A number in (0, 1) drawn for a key at a node."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """Of (name, weight, value) children, the value of the smallest draw; children of weight 0 get nothing."""
    live = [c for c in children if c[1] > 0]
    if not live:
        return F.lit(None).cast("int")
    if len(live) == 1:
        return live[0][2]
    drawn = [F.struct((-F.log(_unit(key, n)) / F.lit(float(w))).alias("draw"), F.lit(i).alias("at")) for i, (n, w, _) in enumerate(live)]
    at = F.least(*drawn)["at"]
    out = F.when(at == 0, live[0][2])
    for i, c in enumerate(live[1:], 1):
        out = out.when(at == i, c[2])
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a string key: a draw at each level of the tree, down to a leaf."""
    regions = []
    for r, region in enumerate(tree.regions):
        racks = []
        for k, rack in enumerate(region):
            leaves = [(f"r{r}/k{k}/s{s}", w, F.lit(s).cast("int")) for s, w in rack]
            racks.append((f"r{r}/k{k}", sum(w for _, w in rack), _winner(key, leaves)))
        regions.append((f"r{r}", sum(w for _, w, _ in racks), _winner(key, racks)))
    return _winner(key, regions)


def assign(df: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``key``: the id and the tree decide. ``size`` is the text's UTF-8 bytes
    plus one and ``text_crc32`` their CRC; null text counts as empty. Null ids share one
    key. ``slot`` runs from 0 without gaps in each shard, in the order of a hash of the
    id, then id, size and CRC; equal rows are one group until slots are dealt, so a
    row that repeats very often is one row in every shuffle. Texts of any length; no rows: no rows.
    Slots are summed up in two levels, within blocks of the hash and over a shard's blocks, each of
    about the square root of the rows. Other columns are ignored.
    """
    tree = tree or Tree.balanced()
    bits = root_bits(df.count())
    id_ = F.col(f"`{id_col}`").cast("long")
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    order = F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("long")
    block = F.shiftright(order, 4 * _DIGITS - bits)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = df.select(id_.alias("_id"))
    per_block = (
        ids.groupBy("_id").agg(F.count("*").alias("_n"))
        .select(shard_of(key, tree).alias("shard"), block.alias("_b"), "_n")
        .groupBy("shard", "_b").agg(F.sum("_n").alias("_n"))
    )
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = per_block.select("shard", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    groups = (
        df.select(
            id_.alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            unsigned32(F.crc32(text.cast("binary"))).alias("text_crc32"),
        )
        .groupBy("_id", "size", "text_crc32")
        .agg(F.count("*").alias("_n"))
        .select("*", shard_of(key, tree).alias("shard"), shard_of(key, tree.grown()).alias("grown_shard"), order.alias("_o"), block.alias("_b"))
    )
    w = Window.partitionBy("shard", "_b").orderBy("_o", "_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(base, ["shard", "_b"])
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
        F.explode(F.sequence(F.col("_base") + F.col("_in"), F.col("_base") + F.col("_in") + F.col("_n") - 1)).alias("slot"),
    )
