import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import extract as X
from cytolake.operators.dictionary import SequenceDictionary

KINDS = "qname string, flag int, contig string, start int, cigar string, xm string, xg string, ordinal long"
NAMES = {"H": "CHH", "X": "CHG", "Z": "CpG", "U": "CN_CHN"}


def walk(start, cigar, xm):
    out, q = [], 0
    for size, op in re.findall(r"(\d+)(\D)", cigar):
        n = int(size)
        if op == "M":
            out += [(start + i, xm[q + i]) for i in range(n) if xm[q + i] != "."]
        q += n if op in "MI" else 0
        start += n if op in "MD" else 0
    return out, start - 1


def expected(fragments):
    counts = {}
    for first, second in fragments:
        calls, end = walk(first[3], first[4], first[5])
        if second is not None:
            overlap = max(0, end - second[3] + 1)
            calls += [c for c in walk(second[3], second[4], second[5])[0] if c[0] >= second[3] + overlap]
        for p, c in calls:
            key = (NAMES[c.upper()], first[2], p, "+" if first[6] == "CT" else "-")
            m, t = counts.get(key, (0, 0))
            counts[key] = (m + c.isupper(), t + 1)
    return counts


def counted(df):
    return {(r["context"], r["contig"], r["position"], r["strand"]): (r["methylated"], r["total"]) for r in df.collect()}


A = ("a", 99, "1", 10, "3M2I4M", "zZxXhHuU.", "CT")
B = ("a", 147, "1", 12, "2M3D3M", "Zzhhx", "GA")
S = ("s", 0, "2", 5, "4M", "z.Z.", "GA")


def reads(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], KINDS)


def test_pair_single_and_unmapped(spark):
    rows = [("u", 4, "*", 0, "*", None, None), A, B, S, ("v", 0, "1", 10, "1M", "Z", "CT")]
    got = counted(X.extract(reads(spark, rows)))
    assert got == expected([(A, B), (S, None), (rows[4], None)])


def test_smaller_start_goes_first_and_gives_the_strand(spark):
    frags = X.fragments(reads(spark, [B, A])).collect()
    assert len(frags) == 1 and frags[0]["first"]["ordinal"] == 1 and frags[0]["second"]["ordinal"] == 0
    tie = X.fragments(reads(spark, [A, (*A[:1], 147, *A[2:])])).first()
    assert tie["first"]["ordinal"] == 0


def test_pairing_is_greedy_along_the_file(spark):
    def row(name, flag):
        return (name, flag, "1", 1, "1M", "Z", "CT")

    rows = [row("a", 1), row("a", 1), row("a", 1), row("b", 1), row("a", 1), row("c", 9), row("c", 9), row("d", 0), row("d", 0), row("e", 4), row("e", 1), row("e", 5)]
    got = sorted((r["first"]["ordinal"], r["second"] and r["second"]["ordinal"]) for r in X.fragments(reads(spark, rows)).collect())
    # three a in a row: a pair and a single; a again after b is alone; c has unmapped mates; d is not paired;
    # an unmapped e is skipped, and the next e takes the one after it along
    assert got == [(0, 1), (2, None), (3, None), (4, None), (5, None), (6, None), (7, None), (8, None), (10, 11)]


def scanned(rows):
    """(first, second) ordinals of fragments, as a scan along the file finds them."""
    out, i = [], 0
    while i < len(rows):
        flag = rows[i][1]
        if not flag & 4:
            taken = flag & 1 and not flag & 8 and i + 1 < len(rows) and rows[i + 1][0] == rows[i][0]
            a, b = (i, i + 1) if taken else (i, None)
            out.append((b, a) if taken and rows[a][3] > rows[b][3] else (a, b))
            i += bool(taken)
        i += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("block,carry", [(1, 3), (1, 65_536), (2, 5), (5, 2), (64, 1), (8_192, 65_536)])
def test_pairing_is_that_of_a_scan_whatever_the_blocks(spark, monkeypatch, block, carry):
    monkeypatch.setattr(X, "CARRY", carry if carry > 100 else 20 * carry)
    rng = np.random.default_rng(block)
    rows, name = [], 0
    for _ in range(400):
        name += rng.random() < 0.3
        rows.append((f"n{name if name % 5 else 0}", int(rng.choice([1, 1, 1, 1, 0, 4, 5, 9])), "1", int(rng.integers(1, 9)), "1M", "Z", "CT"))
    found = X.fragments(reads(spark, rows).repartition(3), block)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert sorted(((r["first"]["ordinal"], r["second"] and r["second"]["ordinal"]) for r in got), key=str) == scanned(rows)


def test_a_million_reads_of_one_name(spark):
    flags = F.when(F.col("id") == 7, 4).otherwise(1)
    many = spark.range(1_000_000).select(F.lit("x").alias("qname"), flags.alias("flag"), F.lit("1").alias("contig"), F.lit(1).alias("start"), F.lit("1M").alias("cigar"), F.lit("Z").alias("xm"), F.lit("CT").alias("xg"), F.col("id").alias("ordinal"))
    seen = X.fragments(many).agg(F.count("*").alias("n"), F.count("second").alias("pairs"), F.max("second.ordinal").alias("last"), F.sum(F.col("second.ordinal") - F.col("first.ordinal")).alias("apart")).first()
    # records 0 to 7 are four pairs, the last of which takes the unmapped record along
    assert seen["pairs"] == seen["n"] == seen["apart"] == 500_000 and seen["last"] == 999_999


def test_second_read_inside_the_first_adds_nothing(spark):
    inner = ("a", 147, "1", 12, "2M", "ZZ", "CT")
    assert counted(X.extract(reads(spark, [A, inner]))) == expected([(A, None)])


@pytest.mark.parametrize("cigar", ["3S4M", "4M1N2M", "4=", "*"])
def test_other_operations_raise(spark, cigar):
    with pytest.raises(Exception, match="unrecognized operation"):
        X.extract(reads(spark, [("a", 0, "1", 1, cigar, "zzzzzzz", "CT")])).collect()


def test_unknown_letter_raises(spark):
    with pytest.raises(Exception, match="unknown methylation call"):
        X.extract(reads(spark, [("a", 0, "1", 1, "2M", "zq", "CT")])).collect()


def test_no_reads(spark):
    assert X.extract(reads(spark, [])).count() == 0


def test_summary_has_every_contig_and_all(spark):
    d = SequenceDictionary((("1", 100), ("2", 100), ("3", 100)))
    counts = X.extract(reads(spark, [A, B, S]))
    rows = {r["contig"]: r for r in X.extract_summary(counts, d.frame(spark)).collect()}
    want = expected([(A, B), (S, None)])
    assert set(rows) == {"1", "2", "3", "All"}
    assert rows["All"]["depth"] == sum(t for _, t in want.values()) / len(want)
    assert rows["All"]["methylation_ratio"] == sum(m for m, _ in want.values()) / sum(t for _, t in want.values())
    assert rows["3"]["depth"] != rows["3"]["depth"] and rows["2"]["depth"] == 1.0
    empty = {r["contig"]: r["depth"] for r in X.extract_summary(counts.limit(0), d.frame(spark)).collect()}
    assert set(empty) == {"1", "2", "3", "All"} and all(x != x for x in empty.values())
