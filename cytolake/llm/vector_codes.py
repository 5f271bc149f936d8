"""Compression of vectors to codes: a codebook for each part of a vector, by filtering Lloyd rounds.

Components become whole numbers. Every partition takes its vectors in blocks and builds a
kd-tree over each part of a block: nodes cache the box, the count and the sum of their
points. The trees are written once and every round reads them. A round walks down a tree
with the entries that can still be nearest to some point of a node's box: the one nearest to
the box's middle rules out each entry that is farther everywhere in the box (a linear test at
one corner). Where one entry is left, the whole subtree is assigned by its cached sum and
count; only leaves with several entries left compare points.

A task sends one sum for each entry that it used, and the driver holds the codebooks alone.
All arithmetic is exact: in doubles while every intermediate is below 2**53, else in whole
numbers of any size. So no result depends on how vectors are dealt to blocks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Codec:
    """parts: of a vector; entries: of a codebook, 256 at most; rounds: of assigning and averaging; scale: of components
    before they are rounded down; leaf: points of a tree's leaf; block: components of a block's vectors."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    leaf: int = 32
    block: int = 1 << 21


# --- trees --------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes from the root downwards, a level after another; node i has the points ``start[i]`` to ``stop[i]`` in the order
    ``order``, and its children are ``child[i]`` and the next one, or none if that is 0."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def _ints(values: np.ndarray) -> np.ndarray:
    """Python's whole numbers, which have any size."""
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def exact(points: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles if sums of squares of four times their size are exact, else as Python's whole numbers."""
    most = int(max(points.max(), -points.min(), 0)) if points.size else 0
    small = 16 * max(points.shape[1], 1) * (most + 1) ** 2 < 1 << 53
    return points.astype(np.float64) if small else _ints(points)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``values`` times ``scale``, rounded down: doubles that are whole, or Python's whole numbers where a double overflows."""
    with np.errstate(over="ignore"):
        made = np.floor(values * scale)
    if np.isfinite(made).all():
        return made
    return np.array([int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in values.ravel()], dtype=object).reshape(values.shape)


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A tree over the rows of ``points``; equal rows are never parted, however many."""
    order, nodes, child = np.arange(len(points)), [(0, len(points))], []
    lows, highs, sums = [], [], []
    for start, stop in nodes:  # grows on the way
        own = points[order[start:stop]]
        low, high = own.min(axis=0), own.max(axis=0)
        lows.append(low)
        highs.append(high)
        sums.append(own.sum(axis=0))
        wide = int(np.argmax(high - low))
        if stop - start <= leaf or high[wide] == low[wide]:
            child.append(0)
            continue
        middle = (stop - start) // 2
        order[start:stop] = order[start:stop][np.argsort(own[:, wide], kind="stable") if own.dtype == object else np.argpartition(own[:, wide], middle)]
        child.append(len(nodes))
        nodes += [(start, start + middle), (start + middle, stop)]
    at = np.array(nodes, dtype=np.int64)
    return Tree(points[order], order, at[:, 0], at[:, 1], np.array(child, dtype=np.int64), np.array(lows), np.array(highs), np.array(sums))


def _distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points.dot(entries.T) + (entries * entries).sum(axis=1)[None, :]


def _nearest(distances: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The first of the least of each row among those alive."""
    if distances.dtype == object:
        far = distances.max() + 1
        return np.array(np.where(alive, distances, far).argmin(axis=1), dtype=np.int64)
    return np.where(alive, distances, np.inf).argmin(axis=1)


def _ruled_out(low: np.ndarray, high: np.ndarray, alive: np.ndarray, best: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``alive`` without the entries that are nowhere in a node's box nearer than its ``best``, nor as near with a lower number."""
    out, norms = alive.copy(), (entries * entries).sum(axis=1)
    node, entry = np.nonzero(alive)
    for at in range(0, len(node), 1 << 15):
        n, e = node[at : at + (1 << 15)], entry[at : at + (1 << 15)]
        b = best[n]
        away = entries[e] - entries[b]
        most = np.maximum(away * low[n], away * high[n]).sum(axis=1)
        gap = norms[e] - norms[b] - 2 * most  # the least of the difference of the two squared distances in the box
        out[n, e] = (e == b) | (gap < 0) | ((gap == 0) & (e < b))
    return out


def assign(tree: Tree, entries: np.ndarray, codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(sums, counts, code of each point) of the points by nearest entry, the lower one of two as near."""
    sums, counts = np.zeros((len(entries), entries.shape[1]), dtype=object), np.zeros(len(entries), dtype=np.int64)
    held = np.zeros(len(tree.points), dtype=np.int64) if codes else None
    if entries.dtype != tree.points.dtype:  # one of them needs whole numbers of any size
        entries = _ints(entries)
        tree = replace(tree, points=_ints(tree.points), low=_ints(tree.low), high=_ints(tree.high), sums=_ints(tree.sums))
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, len(entries)), dtype=bool)

    def add(z: np.ndarray, points: np.ndarray, n: np.ndarray) -> None:
        by = np.argsort(z, kind="stable")
        firsts = np.flatnonzero(np.r_[True, z[by][1:] != z[by][:-1]])
        for k, total, count in zip(z[by][firsts], np.add.reduceat(points[by], firsts, axis=0), np.add.reduceat(n[by], firsts), strict=True):
            sums[k] += [int(x) for x in total]
            counts[k] += count

    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        best = _nearest(_distances(low + high, 2 * entries), alive)
        alive = _ruled_out(low, high, alive, best, entries)
        whole = alive.sum(axis=1) == 1
        if whole.any():
            own = nodes[whole]
            add(best[whole], tree.sums[own], tree.stop[own] - tree.start[own])
            if codes:
                for i, z in zip(own, best[whole], strict=True):
                    held[tree.start[i] : tree.stop[i]] = z
        leaves = ~whole & (tree.child[nodes] == 0)
        if leaves.any():
            sizes = tree.stop[nodes[leaves]] - tree.start[nodes[leaves]]
            of = np.repeat(np.flatnonzero(leaves), sizes)
            rows = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tree.start[nodes[leaves]], sizes)
            for at in range(0, len(rows), 4096):
                r, o = rows[at : at + 4096], of[at : at + 4096]
                z = _nearest(_distances(tree.points[r], entries), alive[o])
                add(z, tree.points[r], np.ones(len(r), dtype=np.int64))
                if codes:
                    held[r] = z
        inner = ~whole & ~leaves
        first = tree.child[nodes[inner]]
        nodes, alive = np.r_[first, first + 1], np.concatenate([alive[inner], alive[inner]])
    if codes:
        back = np.empty_like(held)
        back[tree.order] = held
        held = back
    return sums, counts, held


# --- tasks --------------------------------------------------------------------


def _plant(how: Codec):
    """Rows (key struct, vector) to rows (keys of a block, its trees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            keys = pa.concat_arrays([b.column(0) for b in held])
            raw = pa.concat_arrays([b.column(1) for b in held])
            flat = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            made = whole(flat.reshape(len(raw), -1), how.scale)
            width = made.shape[1] // how.parts
            trees = [grow(exact(made[:, k * width : (k + 1) * width]), how.leaf) for k in range(how.parts)]
            keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([keys, pa.array([pickle.dumps(trees, 5)], pa.binary())], ["keys", "trees"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                width = max(len(b.column(1)[at]), 1)
                take = min(b.num_rows - at, max(how.block // width, 1) - rows)
                held.append(b.slice(at, take))
                rows, at = rows + take, at + take
                if rows >= max(how.block // width, 1):
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    return run


def _arrays(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    return [exact(np.array(book, dtype=object).reshape(len(book), -1)) if book else np.zeros((0, 0)) for book in codebooks]


def _summed(how: Codec, codebooks: list[list[list[int]]]):
    """Trees to (part, entry, count, sums): one row for each entry that the task's points are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, found = _arrays(codebooks), {}
        for b in batches:
            for raw in b.column(0):
                for part, tree in enumerate(pickle.loads(raw.as_py())):
                    sums, counts, _ = assign(tree, books[part], False)
                    for k in np.flatnonzero(counts):
                        n, total = found.get((part, k), (0, 0))
                        found[part, k] = (n + int(counts[k]), total + sums[k])
        rows = [(p, int(k), n, ",".join(map(str, total))) for (p, k), (n, total) in found.items()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "n", "sums"])

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """The rows of an entry, one for each task, to its components: averages, rounded down."""
    total = np.sum([np.array([int(x) for x in s.split(",")], dtype=object) for s in rows["sums"].to_pylist()], axis=0)
    n = sum(rows["n"].to_pylist())
    made = ",".join(str(int(x) // n) for x in total)
    return pa.table({"part": rows["part"].slice(0, 1), "entry": rows["entry"].slice(0, 1), "made": pa.array([made], pa.string())})


def _coded(how: Codec, codebooks: list[list[list[int]]]):
    """(keys, trees) to rows (key, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _arrays(codebooks)
        for b in batches:
            for i in range(b.num_rows):
                keys = b.column(0).slice(i, 1).flatten()
                codes, errors = np.zeros((len(keys), how.parts), dtype=np.uint8), np.zeros(len(keys), dtype=object)
                for part, tree in enumerate(pickle.loads(b.column(1)[i].as_py())):
                    _, _, codes[:, part] = assign(tree, books[part], True)
                    points = np.empty_like(tree.points)
                    points[tree.order] = tree.points
                    book = books[part]
                    if book.dtype != points.dtype:
                        book, points = _ints(book), _ints(points)
                    gap = points - book[codes[:, part]]
                    errors += _ints((gap * gap).sum(axis=1))
                text = codes.tobytes().hex()
                size = 2 * how.parts
                code = [text[k * size : (k + 1) * size] for k in range(len(keys))]
                error = pa.array([min(int(x), _MOST) for x in errors], pa.int64())
                for at in range(0, len(keys), 10_000):
                    yield pa.RecordBatch.from_arrays([keys.slice(at, 10_000), pa.array(code[at : at + 10_000]), error.slice(at, 10_000)], ["key", "code", "error"])

    return run


# --- the operator -------------------------------------------------------------


@dataclass(frozen=True)
class Compressed:
    """``codes``: id, label, code, error, label_error; ``codebooks``: components by part, entry and position."""

    codes: DataFrame
    codebooks: list[list[list[int]]]

    @property
    def sha256(self) -> str:
        """Of the components as decimals with commas between them, lowercase hex."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for e in book for x in e).encode()).hexdigest()


def _with_label_errors(coded: DataFrame, key: list[str]) -> DataFrame:
    """``coded`` with ``label_error``. Labels with a thousandth of the rows or more, so a thousand at most, are joined
    by broadcast; the others' rows meet by label."""
    total_error = F.coalesce(F.try_sum("error"), F.lit(_MOST)).alias("label_error")
    sums = save(coded.groupBy(F.col("key.label").alias("l")).agg(total_error, F.count("*").alias("rows")), "code-labels")
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    often = sums.where(F.col("rows") * 1000 >= total).select(F.col("l").alias("l1"), F.col("label_error").alias("e1"))
    seldom = sums.where(F.col("rows") * 1000 < total).select(F.col("l").alias("l2"), F.col("label_error").alias("e2"))
    hot = coded.join(F.broadcast(often), F.col("key.label").eqNullSafe(F.col("l1")), "left")
    common = hot.where("e1 is not null").select(*key, "code", "error", F.col("e1").alias("label_error"))
    rare = hot.where("e1 is null").join(seldom, F.col("key.label").eqNullSafe(F.col("l2"))).select(*key, "code", "error", F.col("e2").alias("label_error"))
    return common.unionByName(rare)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", how: Codec | None = None) -> Compressed:
    """Codes of the vectors in ``df`` by codebooks that are fitted on all of them.

    Null vectors and those with null or non-finite components are dropped; so are empty ones, those that cannot be cut into
    equal parts, and those of another length than that of the smallest id. The first codebooks are the vectors of the
    smallest ids; rows of one id go by their vectors, and null ids come last. Equal rows are vectors of their own. With fewer
    vectors than entries a codebook is as large as there are vectors. An entry that nothing is nearest to stays as it is.
    Null labels sum up together. Components of any finite size are exact; an error beyond 64 bits is the greatest number of
    64 bits. No rows: no codes and empty codebooks. Other columns are ignored, whatever their names."""
    how = how or Codec()
    if not 0 < how.entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so 1 to 256 entries")
    col = lambda c: F.col(f"`{c}`")
    rows = df.select(F.struct(col(id_col).alias("id"), col(label_col).alias("label")).alias("key"), col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("v").isNotNull() & sound & (F.size("v") > 0) & (F.size("v") % how.parts == 0))

    def smallest(of: DataFrame) -> list[list[float]]:
        return [r["v"] for r in of.orderBy(F.col("key.id").asc_nulls_last(), "v").limit(how.entries).select("v").collect()]  # a codebook's worth

    seeds = smallest(rows)
    dim = len(seeds[0]) if seeds else how.parts
    rows = rows.where(F.size("v") == dim)
    seeds = seeds if all(len(s) == dim for s in seeds) else smallest(rows)
    width = dim // how.parts
    first = [[int(x) for x in row] for row in whole(np.array(seeds, dtype=np.float64).reshape(len(seeds), dim), how.scale)]
    books = [[row[k * width : (k + 1) * width] for row in first] for k in range(how.parts)]

    kind = rows.schema["key"].dataType.simpleString()
    trees = save(rows.mapInArrow(_plant(how), f"keys array<{kind}>, trees binary"), "code-trees")
    for _ in range(how.rounds if seeds else 0):
        summed = trees.select("trees").mapInArrow(_summed(how, books), "part int, entry int, n long, sums string")
        for r in summed.groupBy("part", "entry").applyInArrow(_averaged, "part int, entry int, made string").collect():  # a row for each entry
            books[r["part"]][r["entry"]] = [int(x) for x in r["made"].split(",")]
    coded = save(trees.mapInArrow(_coded(how, books), f"key {kind}, code string, error long"), "codes")
    key = [F.col("key.id").alias(id_col), F.col("key.label").alias(label_col)]
    return Compressed(_with_label_errors(coded, key), books)
