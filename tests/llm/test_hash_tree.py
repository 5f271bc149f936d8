import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cytolake.llm import hash_tree as H

KINDS = "doc_id long, text string, shard string"


def frame(spark, n=3000):
    rows = [(i, f"text {i % 500} é", "x") for i in range(n)] + [(n, None, "x"), (n + 1, "", "x"), (None, "no id", "x"), (None, None, "x")]
    rows += [(5, "text 5 é", "x")] * 400 + [(6, "other", "x")]
    return rows, spark.createDataFrame(rows, KINDS).repartition(4)


def test_rows_slots_and_digests(spark):
    rows, df = frame(spark)
    got = H.assign(df).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = {}
    for r in got:
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    moved = sum(r["grown_shard"] == 8 for r in got if r["doc_id"] not in (5, None)) / 3000
    assert 0.08 < moved < 0.15
    assert H.assign(df.limit(0)).count() == 0
    again = H.assign(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def shards(spark, tree, n=20_000):
    return [r[0] for r in spark.range(n).select(H.shard_of(F.col("id").cast("string"), tree)).collect()]


def test_weights_decide_the_shares(spark):
    tree = H.Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 0.0), (4, 2.0)))))
    got = Counter(shards(spark, tree))
    assert 3 not in got
    for shard, weight in ((0, 1), (1, 3), (2, 2), (4, 2)):
        assert abs(got[shard] / 20_000 - weight / 8) < 0.015


def test_movement_stays_where_weights_change(spark):
    tree = H.Tree.balanced(2, 2, 2)
    before, after = shards(spark, tree), shards(spark, tree.reweighted(0, 2.0))
    for a, b in zip(before, after, strict=True):
        # a row moves into the region, rack or shard that has grown, and never between those that have not
        assert a == b or (a // 4 != 0 and b // 4 == 0) or (a // 4 == 0 and a // 2 != 0 and b // 2 == 0) or b == 0
    gone = shards(spark, tree.reweighted(7, 0.0))
    assert 7 not in gone
    grown = shards(spark, tree.grown())
    assert all(a == b or b == 8 for a, b in zip(before, grown, strict=True)) and 8 in grown


def test_trees(spark):
    assert H.Tree.balanced().shards == list(range(8)) and H.Tree.balanced().grown().shards == list(range(9))
    assert set(shards(spark, H.Tree(((((4, 1.0),),),)), 10)) == {4}
    with pytest.raises(IndexError):
        H.Tree.balanced().regions[2]


def test_plan_without_python(spark):
    _, df = frame(spark, 10)
    assert "Python" not in H.assign(df)._jdf.queryExecution().toString()
