"""Merkle manifests of a dataset, with proofs by lookup of coordinates.

Every row is a leaf, the leaves of a source are a tree, and the roots of the sources are
the leaves of one more tree, whose root stands for the dataset. Nodes are a table keyed by
coordinates: tree, level and index. From its index and its tree's number of leaves alone a
leaf knows the coordinates of all the siblings that prove it; they are exploded, joined with
the table of nodes, put in order and joined to one text, and folding the leaf along that
text gives the root again.

Nothing is gathered by source, so one that holds most rows is work for all tasks: indexes
come from a range sort and counts by partition, and levels are built, and looked up, in
bands of ``DEPTH`` levels, whose blocks have at most ``group ** DEPTH`` nodes. A leaf looks
up its siblings in its own band; those above are looked up once for each block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save

#: Consecutive nodes that become one.
GROUP = 3
#: Levels of a band, of groups of three; blocks of wider groups are about as large.
DEPTH = 5
#: Number of the tree over the sources; sources are numbered from 0 in order.
UPPER = -1
_HEX = 64  # characters of a digest as text


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _depth(group: int) -> int:
    depth = 1
    while group ** (depth + 1) <= GROUP**DEPTH:
        depth += 1
    return depth


def _powers(group: int) -> list[int]:
    """Leaves below a node of each level, as far as they can be counted."""
    out = [1]
    while out[-1] * group < 1 << 61:
        out.append(out[-1] * group)
    return out


def _levels(size: Column, group: int) -> Column:
    """The powers of the levels below the root of a tree of ``size`` leaves, an array; its length is the root's level."""
    return F.filter(F.array(*[F.lit(p).cast("long") for p in _powers(group)]), lambda p: p < size)


def _height(size: Column, group: int) -> Column:
    return F.size(_levels(size, group))


def height(size: int, group: int = GROUP) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return sum(p < size for p in _powers(group))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*values: Column) -> Column:
    """SHA-256, lowercase hex, of the values one after another: ``-`` for null, else the UTF-8 length, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, size, index, digest (binary), the id and what is carried; ``nodes``: tree, size, level, index,
    digest, leaves included; ``sources``: source, tree, size, subroot (binary); ``root``: hex, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    n_sources: int
    largest: int
    root: str | None
    group: int


def _indexed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, size and index; source, tree, size), from rows (source, id, digest, ...).

    The rows are range-sorted and written. A partition then has a run of rows for each of its sources; sources and rows
    before a partition are sums over one row for each partition."""
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may go to several partitions
    order = ["source", "id", "digest", "_tie"]
    placed = save(
        ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("line", F.monotonically_increasing_id()), "merkle-leaves"
    ).withColumns({"part": F.shiftright("line", 33), "row": F.col("line").bitwiseAND((1 << 33) - 1)}).drop("line")
    runs = placed.groupBy("part", "source").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    runs = save(runs, "merkle-runs")
    own = runs.groupBy("source").agg(F.min(F.struct("part", "first")).alias("b"), F.sum("n").alias("size")).select("source", "size", "b.*")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = own.groupBy("part").agg(F.count("*").alias("begun"))
    parts = runs.groupBy("part").agg(F.sum("n").alias("n")).join(begun, "part", "left").select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.coalesce("begun", F.lit(0))).over(before), F.lit(0)).alias("trees")
    )
    sources = own.join(parts, "part").select("source", "size", (F.col("trees") + F.col("nth")).alias("tree"), (F.col("rows") + F.col("first")).alias("start"))
    sources = save(sources, "merkle-sources")
    r, s = runs.join(parts.select("part", "rows"), "part").alias("r"), sources.alias("s")
    shifts = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        F.col("r.part").alias("part"), F.col("r.source").alias("source"), "s.tree", "s.size", (F.col("r.rows") - F.col("s.start")).alias("shift")
    )
    x, p = save(shifts, "merkle-shifts").alias("x"), placed.alias("p")
    # a run is no longer than a partition, so no source is a hot key here
    joined = p.join(x, (F.col("p.part") == F.col("x.part")) & F.col("p.source").eqNullSafe(F.col("x.source")))
    kept = [F.col(f"p.`{c}`") for c in placed.columns if c not in ("part", "row")]
    indexed = joined.select("x.tree", "x.size", (F.col("p.row") + F.col("x.shift")).alias("index"), *kept)
    return indexed, sources.select("source", "tree", "size")


def _next_level(below: Column, group: int) -> Column:
    """Digests of the groups of an array of digests, both as text."""
    runs = F.sequence(F.lit(0).cast("long"), _div(F.size(below) - 1, group))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, (i * group + 1).cast("int"), group), ""), 256))


def _coordinates(digests: str, level: int, first: Column) -> Column:
    return F.transform(digests, lambda x, i: F.struct(F.lit(level).alias("level"), (first + i).alias("index"), F.unhex(x).alias("digest")))


def _built(leaves: DataFrame, largest: int, group: int) -> list[DataFrame]:
    """(tree, size, level, index, digest) of the nodes above ``leaves`` (tree, size, index, digest), band by band."""
    depth, out, below = _depth(group), [], leaves
    tall = _height(F.col("size"), group)
    for base in range(0, height(largest, group), depth):
        wide = group**depth
        blocks = below.groupBy("tree", "size", _div(F.col("index"), wide).alias("block")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("own"))
        blocks = blocks.withColumn("l0", F.transform("own", lambda x: _text(x["digest"]))).drop("own")
        made = []
        for k in range(1, depth + 1):
            blocks = blocks.withColumn(f"l{k}", _next_level(F.col(f"l{k - 1}"), group))
            made.append(_coordinates(f"l{k}", base + k, F.col("block") * group ** (depth - k)))
        nodes = blocks.select("tree", "size", F.inline(F.filter(F.flatten(F.array(*made)), lambda x: x["level"] <= tall)))
        out.append(save(nodes, "merkle-nodes"))
        below = out[-1].where((F.col("level") == base + depth) & (tall > base + depth)).drop("level")
    return out


def _one_table(leaves: DataFrame, inner: list[DataFrame]) -> DataFrame:
    own = leaves.select("tree", "size", F.lit(0).alias("level"), "index", "digest")
    return reduce(DataFrame.unionByName, inner, own)


def build(
    docs: DataFrame, columns: list[str], id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None, group: int = GROUP
) -> Manifest:
    """The manifest of ``docs``, whose leaves are digests of ``columns``.

    Leaves of a source ascend by id, null first; rows of one id by their digests, and equal rows are leaves of their own.
    Null is a source like any other, before the others; sources are in the order of their UTF-8 bytes. Null values and
    empty texts have different digests; texts of any length are hashed whole. An empty table has no root. Other columns
    are ignored, whatever their names; ``carry`` has columns to keep beside the leaves."""
    if group < 2:
        raise ValueError("a group has two nodes or more")
    col = lambda c: F.col(f"`{c}`")
    carry = carry or {}
    if taken := set(carry) & {"tree", "size", "index", "id", "source", "digest", "part", "row", "line", "_tie", "block", "proof", "level", "subroot", "wide"}:
        raise ValueError(f"columns carried cannot be named {sorted(taken)}")
    rows = docs.select(
        col(source_col).cast("string").alias("source"), col(id_col).alias("id"), F.unhex(leaf_digest(*map(col, columns))).alias("digest"), *[v.alias(k) for k, v in carry.items()]
    )
    once = save(rows, "merkle-rows")  # texts are hashed once, not again for the sample of the range sort
    leaves, sources = _indexed(once)
    drop(once)
    n, largest = sources.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    tall = _height(F.col("size"), group)
    lower = _one_table(leaves, _built(leaves.select("tree", "size", "index", "digest"), largest, group))
    subroots = save(lower.where(F.col("level") == tall).select(F.col("tree").alias("index"), "digest"), "merkle-subroots")
    top = subroots.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), "index", "digest")
    upper = _one_table(top, _built(top, n, group))
    root = upper.where(F.col("level") == height(n, group)).select(_text(F.col("digest"))).first()  # one node
    sources = sources.join(subroots.withColumnsRenamed({"index": "tree", "digest": "subroot"}), "tree")
    return Manifest(leaves, lower.unionByName(upper), sources, n, largest, root[0] if root else None, group)


def _others(place: Column, count: Column, level: int, group: int) -> Column:
    first = place - place % group
    run = F.filter(F.sequence(first, F.least(first + group - 1, count - 1)), lambda x: x != place)
    return F.transform(run, lambda x: F.struct(F.lit(level).alias("level"), x.alias("at")))


def _siblings(base: int, group: int) -> Column:
    """Coordinates (level, at) of the siblings in the band from level ``base``, by index and size alone."""
    out = []
    for k in range(_depth(group)):
        place = _div(F.col("index"), group**k)
        count = _div(F.col("size") + group ** (base + k) - 1, group ** (base + k))
        out.append(_others(place, count, base + k, group))
    return F.flatten(F.array(*out))


def _proved(wanted: DataFrame, nodes: DataFrame, tops: DataFrame, largest: int, group: int, carried: list[str]) -> DataFrame:
    """``wanted`` (tree, size, index, carried ones) with ``proof``: siblings to the tree's root, level by level, and then the
    ``proof`` that ``tops`` (tree, size, proof) has for the root itself. From the highest band down."""
    depth, above = _depth(group), None
    wide = group**depth
    tall = _height(F.col("size"), group)
    for base in range(max(0, (max(height(largest, group), 1) - 1) // depth * depth), -1, -depth):
        kept = carried if base == 0 else []
        own = wanted if base == 0 else nodes.where((F.col("level") == base) & (tall > base)).select("tree", "size", "index")
        asked = own.select("tree", F.col("index").alias("asks"), F.inline(_siblings(base, group))).withColumnRenamed("at", "index")
        found = asked.join(nodes.select("tree", "level", "index", "digest"), ["tree", "level", "index"]).select("tree", "asks", F.struct("level", "index", "digest").alias("found"))
        self_ = own.select("tree", F.col("index").alias("asks"), F.struct("size", *[f"`{c}`" for c in kept]).alias("self"))
        both = found.unionByName(self_, allowMissingColumns=True).withColumn("block", _div(F.col("asks"), wide))
        n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(n, "tree", "block")  # for the grouping and for the join with what is above
        proofs = dealt.groupBy("tree", "block", "asks").agg(F.sort_array(F.collect_list("found")).alias("found"), F.first("self", ignorenulls=True).alias("self"))
        proofs = proofs.select("tree", "block", F.col("asks").alias("index"), "self.*", F.array_join(F.transform("found", lambda x: _text(x["digest"])), "").alias("low"))
        last = tops.where((tall <= base + depth) & ((tall > base) | F.lit(base == 0))).select("tree", F.lit(0).cast("long").alias("block"), "proof")
        upon = last if above is None else last.unionByName(above.select("tree", F.col("index").alias("block"), "proof"))
        above = proofs.join(upon, ["tree", "block"]).select("tree", "size", "index", *kept, F.concat("low", "proof").alias("proof"))
    return above


def prove(manifest: Manifest) -> DataFrame:
    """Every leaf with ``proof``, the digests of its siblings to the root of the dataset as one hex text, level by level and
    left to right, and ``subroot`` (hex)."""
    m, group = manifest, manifest.group
    top = m.sources.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(m.n_sources).cast("long").alias("size"), F.col("tree").alias("index"))
    root = m.leaves.sparkSession.range(1).select(F.lit(UPPER).cast("long").alias("tree"), F.lit(m.n_sources).cast("long").alias("size"), F.lit("").alias("proof"))
    upper = _proved(top, m.nodes, root, m.n_sources, group, []).select(F.col("index").alias("tree"), "proof")
    tops = save(m.sources.join(upper, "tree").select("tree", "size", F.concat(_text(F.col("subroot")), "proof").alias("proof")), "merkle-tops")
    carried = [c for c in m.leaves.columns if c not in ("tree", "size", "index")]
    out = _proved(m.leaves, m.nodes, tops, m.largest, group, carried)
    # the root of the tree came along in front of what proves it
    at = F.length("proof") - F.lit(_HEX) - F.lit(_HEX) * F.size(F.flatten(_upper_runs(F.col("tree"), m.n_sources, group))) + 1
    return out.withColumns({
        "subroot": F.substr("proof", at, F.lit(_HEX)),
        "proof": F.concat(F.substr("proof", F.lit(1), at - 1), F.substr("proof", at + _HEX, F.length("proof"))),
    })


def _run(index: Column, size: Column, power: Column | int, group: int) -> tuple[Column, Column]:
    """Siblings to the left and to the right of the node over leaf ``index`` at the level of ``power``."""
    place = _div(index, power)
    left = place % group
    last = F.least(place - left + group - 1, _div(size + power - 1, power) - 1)
    return left, last - place


def _upper_runs(tree: Column, n_sources: int, group: int) -> Column:
    """An array for each level of the tree over the sources, as long as a source has siblings there."""
    made = []
    for p in _powers(group):
        if p >= n_sources:
            break
        left, right = _run(tree, F.lit(n_sources).cast("long"), p, group)
        made.append(F.array_repeat(F.lit(1), (left + right).cast("int")))
    return F.array(*made) if made else F.array(F.array().cast("array<int>"))


def fold(digest: Column, index: Column, size: Column, proof: Column, group: int = GROUP, at: Column | int = 1) -> Column:
    """A struct: ``digest``, the root that ``digest`` (hex) of leaf ``index`` of ``size`` leads to along ``proof`` from its
    character ``at`` on, and ``at``, the next character. Tells nothing of null; a proof that is too short folds what it has."""
    zero = F.struct((F.lit(at) if isinstance(at, int) else at).cast("int").alias("at"), digest.alias("digest"))

    def step(s: Column, p: Column) -> Column:
        left, right = _run(index, size, p, group)
        low, high = (left * _HEX).cast("int"), (right * _HEX).cast("int")
        joined = F.concat(F.substr(proof, s["at"], low), s["digest"], F.substr(proof, s["at"] + low, high))
        return F.struct((s["at"] + low + high).alias("at"), F.sha2(joined, 256).alias("digest"))

    return F.aggregate(_levels(size, group), zero, step)


def folded_root(manifest: Manifest, digest: Column) -> Column:
    """The root that ``digest`` (hex) leads to in the row of a leaf of ``prove``."""
    lower = fold(digest, F.col("index"), F.col("size"), F.col("proof"), manifest.group)
    over = F.transform(F.array(lower), lambda s: fold(s["digest"], F.col("tree"), F.lit(manifest.n_sources).cast("long"), F.col("proof"), manifest.group, s["at"]))
    return over[0]["digest"]
