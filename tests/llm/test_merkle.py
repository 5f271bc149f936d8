"""Merkle manifests against trees built plainly."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cytolake.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
KINDS = "doc_id long, source string, lang string, n_chars int, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, group):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + group]) for i in range(0, len(out[-1]), group)])
    return out


def siblings(tree, i, group):
    out = ""
    for level in tree[:-1]:
        first = i - i % group
        out += "".join(h for k, h in enumerate(level[first : first + group], first) if k != i)
        i //= group
    return out


def brute(rows, group):
    """(doc_id, leaf, subroot, root, proof)"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = {}, {}
    for s in sources:
        own[s] = sorted(((r[0], leaf(r)) for r in rows if r[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([h for _, h in own[s]], group)
    top = levels([trees[s][-1][0] for s in sources], group)
    return [
        (d, h, trees[s][-1][0], top[-1][0], siblings(trees[s], i, group) + siblings(top, k, group)) for k, s in enumerate(sources) for i, (d, h) in enumerate(own[s])
    ]


def found(spark, rows, group=3, extra=()):
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], KINDS + "".join(f", `{c}` string" for c in extra)).repartition(3)
    m = merkle.build(docs, COLUMNS, group=group)
    proved = merkle.prove(m).withColumn("folded", merkle.folded_root(m, F.lower(F.hex("digest"))))
    out = proved.select("id", F.lower(F.hex("digest")), "subroot", F.lit(m.root).cast("string"), "proof", "folded").collect()
    assert all(r["folded"] == m.root for r in out)
    return sorted((tuple(r)[:5] for r in out), key=str)


def made(n, sources=5, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([*(f"s{k}" for k in range(sources)), "big", "big", "big", None]), rng.choice(["en", None]), rng.randint(0, 9), f"text {i}\n é" * rng.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize("group", [2, 3, 7, 300])
def test_as_plain_trees(spark, group):
    rows = made(1200)  # a source of more than a block, so several bands
    assert found(spark, rows, group) == sorted(brute(rows, group), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 243, 244, 245])
def test_sizes_of_one_source(spark, n):
    rows = [(i, "a", None, None, None) for i in range(n)]
    assert found(spark, rows) == sorted(brute(rows, 3), key=str)


def test_many_sources(spark):
    rows = [(i, f"s{i % 400}", "en", i, "x") for i in range(500)]
    assert found(spark, rows) == sorted(brute(rows, 3), key=str)


def test_edges(spark):
    """Nulls, empty and long texts, repeated ids and equal rows, bytewise order of sources, clashing names."""
    rows = [
        (1, "b", "en", 0, ""), (1, "b", "en", 0, None), (2, "b", "en", 3, "ab\n"), (2, "b", "en", 3, "ab\n"), (2, "b", "en", 3, "ab\n"), (None, "b", None, None, "x"),
        (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", 1, "é"), (5, "Z", "en", 1, "word " * 600_000), (6, "é", "en", 1, "-"), (7, "-", "en", 1, "1:a"),
    ]
    want = sorted(brute(rows, 3), key=str)
    assert found(spark, rows) == want
    assert found(spark, rows, extra=["tree", "size", "index", "id", "digest", "level", "proof", "_tie", "line", "part"]) == want
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame(rows, KINDS), COLUMNS, carry={"tree": F.lit(1)})


def test_equal_rows_are_dealt_out(spark):
    rows = [(7, "a", "en", 1, "same")] * 700
    assert found(spark, rows) == sorted(brute(rows, 3), key=str)


def test_empty(spark):
    m = merkle.build(spark.createDataFrame([], KINDS), COLUMNS)
    assert m.root is None and merkle.prove(m).collect() == []


def test_tampering_is_told(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, KINDS)
    m = merkle.build(docs, COLUMNS, carry={"other": merkle.leaf_digest(*[F.lit("no") if c == "text" else F.col(c) for c in COLUMNS])})
    out = merkle.prove(m).select(merkle.folded_root(m, F.col("other")).alias("r")).distinct().collect()
    assert all(r["r"] != m.root for r in out)
