"""Connected components by alternating large-star and small-star rounds.

Edges are first contracted inside each partition by union-find, so a round
moves at most one edge per node and partition, however dense the input. No
group is ever gathered: a node's smallest neighbour is a partial aggregate,
and the join that hands it to the node's edges can be split where a node is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save

EDGES = "src long, dst long"
#: A contracted graph of at most this many edges is finished in one task; a larger one goes on in rounds.
ONE_TASK = 250_000


class Forest:
    """Union-find over integers that keeps the smallest member as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links ``a[k]``-``b[k]`` in hand, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        for ends in (i, j, low[i], low[j]):
            np.minimum.at(new, ends, least)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == low).all():
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[away], nodes[low[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.link(x, y)
    nodes = np.fromiter(forest.up, dtype=np.int64, count=len(forest.up))
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        roots = np.fromiter((forest.root(int(x)) for x in part), dtype=np.int64, count=len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(roots)], ["src", "dst"])


def contract(edges: DataFrame) -> DataFrame:
    """The same components with one edge per node and partition: (node, root)."""
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(_contract, EDGES)


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it reaches.

    ``edges`` has ``src`` and ``dst``, in any direction, repeats and self-links
    allowed; rows with a null end are ignored. No edges: no rows. The result is the
    same whether or not a small graph is finished in one task.
    """
    clean = edges.where("src is not null and dst is not null and src != dst")
    now = save(contract(clean), "edges")
    seen = _mark(now)
    if 0 < seen[0] <= one_task:
        done = save(contract(now.coalesce(1)), "edges")
        drop(now)
        now, seen = done, (0,)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        nxt = save(contract(_small_star(_large_star(now))).distinct(), "edges")
        mark = _mark(nxt)
        drop(now)
        now, before, seen = nxt, seen, mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest: equal marks mean that a round changed nothing."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("dst", "src"))
    ).first()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node's neighbourhood."""
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low"))
    return (
        both.join(low, "src")
        .where("dst > src")
        .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = e.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(low.select("src", F.col("low").alias("dst")))
