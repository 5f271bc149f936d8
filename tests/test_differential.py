import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytolake.functions.numeric import safe_div
from cytolake.sinks import write_regions
from cytolake.functions.stats import close_to, two_tailed_p
from cytolake.operators import differential as D
from cytolake.operators.dictionary import SequenceDictionary

KINDS = "contig string, position int, strand string, methylated int, total int, condition int, sample_id int"
DICT = SequenceDictionary((("2", 10_000_000), ("19", 10_000_000)))


def t_tail(t, df):
    """Two-tailed probability by integrating the density."""
    x = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(y, x)


def expected(rows):
    """(mean1, mean2, t, p) of (value, weight, condition) rows, in two passes."""
    stats = []
    for chosen in ([r for r in rows if r[2] == 0], [r for r in rows if r[2] != 0]):
        v, w = np.array([r[0] for r in chosen]), np.array([float(r[1]) for r in chosen])
        if len(v) < 2:
            return None
        m = (v * w).sum() / w.sum()
        stats.append((len(v), m, w.sum() / (w.sum() ** 2 - (w * w).sum()) * (w * (v - m) ** 2).sum()))
    (n1, m1, v1), (n2, m2, v2) = stats
    p = v1 / n1 + v2 / n2
    if p == 0:
        return m1, m2, None, None
    t, df = (m1 - m2) / math.sqrt(p), p * p / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return m1, m2, t, t_tail(t, df)


@pytest.mark.parametrize("t,df", [(0.5, 1), (2.0, 2), (-6.76, 4.3), (12, 3), (0.001, 50), (1.7, 1e4), (3, 1.5), (-1.48, 120.5)])
def test_student_t(spark, t, df):
    got = spark.range(1).select(two_tailed_p(F.lit(float(t)), F.lit(float(df)))).first()[0]
    want = 1 - abs(t) / math.sqrt(t * t + 2) if df == 2 else t_tail(t, df)
    assert math.isclose(got, want, rel_tol=1e-7, abs_tol=1e-9)


def test_student_t_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(inf, 3.0), (-inf, 3.0), (0.0, 3.0), (nan, 3.0), (1.0, nan), (inf, nan), (None, 3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, df double").select(two_tailed_p(F.col("t"), F.col("df"))).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and all(map(math.isnan, got[3:6])) and got[6] is None


def test_division_as_in_ieee_754(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (1.0, 4.0), (None, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(safe_div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [float("inf"), -float("inf")] and all(map(math.isnan, got[2:4])) and got[4:] == [0.25, None]


def test_close_to(spark):
    rows = [(1.0, 1.005, True), (1.0, 1.02, False), (float("nan"), float("nan"), True), (0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "a double, b double, w boolean")
    assert all(r[0] == r[1] for r in df.select(close_to(F.col("a"), F.col("b")), "w").collect())


def test_sites_against_two_passes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(1, 41):
        for s in range(6):
            total = int(rng.integers(1, 20))
            rows.append(("2", p, "+", int(rng.binomial(total, 0.8 if s < 3 and p % 3 else 0.3)), total, int(s < 3), s))
    got = {r["position"]: r for r in D.differential_sites(spark.createDataFrame(rows, KINDS), significance=None).collect()}
    seen = 0
    for p in range(1, 41):
        want = expected([(m / t, t, c) for _, q, _, m, t, c, _ in rows if q == p and t >= 3])
        if want is None:
            assert p not in got
        elif want[2] is not None:
            seen += 1
            r = got[p]
            have = (r["sample1_mean"], r["sample2_mean"], r["t_statistic"], r["p_value"])
            assert np.allclose(have, want, rtol=1e-7, atol=1e-9)
    assert seen > 20


def test_sites_without_variance_are_never_significant(spark):
    rows = [("2", 1, "+", m, 4, c, s) for s, (m, c) in enumerate([(4, 0), (4, 0), (0, 1), (0, 1)])]
    df = spark.createDataFrame(rows, KINDS)
    assert D.differential_sites(df).count() == 0
    (r,) = D.differential_sites(df, significance=None).collect()
    assert r["t_statistic"] == float("inf") and math.isnan(r["p_value"])


def test_any_condition_but_zero_is_the_second_sample(spark):
    rows = [("2", 1, "+", m, 10, c, s) for s, (m, c) in enumerate([(9, 0), (10, 0), (9, 0), (1, 7), (0, 3), (2, 1)])]
    (r,) = D.differential_sites(spark.createDataFrame(rows, KINDS)).collect()
    assert r["sample1_mean"] > r["sample2_mean"] and r["t_statistic"] > 0


REGIONS = [("in", "2", 10, 20), ("copy", "2", 10, 20), ("wide", "2", 1, 9_999_999), ("empty", "19", 5, 6), ("gone", "X", 1, 9), ("point", "2", 12, 12)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([1, 7, 1000, 16_384]))
def test_regions_against_a_nested_loop(spark, seed, bin_size):
    rng = np.random.default_rng(seed)
    rows = [("2", int(p), "+", int(rng.integers(0, 9)), 9, int(s < 3), s) for s in range(6) for p in rng.integers(1, 40, 8)]
    regions = spark.createDataFrame([r for r in REGIONS if bin_size > 100 or r[0] != "wide"], "id string, contig string, start int, stop int")
    calls = spark.createDataFrame(rows, KINDS)
    inside = sorted((r["id"], r["position"], r["sample_id"], r["methylated"]) for r in D.region_calls(calls, regions, bin_size).collect())
    kept = [r for r in REGIONS if bin_size > 100 or r[0] != "wide"]
    assert inside == sorted((i, p, s, m) for i, c, a, b in kept for k, p, _, m, _, _, s in rows if k == c and a <= p <= b)
    got = {r["id"]: r for r in D.differential_regions(calls, regions, DICT.frame(spark), bin_size=bin_size).collect()}
    assert set(got) == {r[0] for r in kept} - {"gone"}
    for i, c, a, b in kept:
        if i == "gone":
            continue
        want = expected([(m / t, t, g) for k, p, _, m, t, g, _ in rows if k == c and a <= p <= b])
        if want is None:
            assert got[i]["sample1_mean"] is None and got[i]["p_value"] is None
        elif want[2] is not None:
            assert np.allclose((got[i]["t_statistic"], got[i]["p_value"]), want[2:], rtol=1e-7, atol=1e-9)


def test_region_order_keeps_ties(spark, tmp_path):
    regions = D.with_ordinals(spark.createDataFrame([("z", "19", 1, 2), ("b", "2", 5, 9), ("a", "2", 5, 6), ("c", "2", 1, 9)], "id string, contig string, start int, stop int").coalesce(1))
    calls = spark.createDataFrame([], KINDS)
    write_regions(D.differential_regions(calls, regions, DICT.frame(spark)), str(tmp_path / "r"), DICT)
    assert [x.split("\t")[0] for x in open(tmp_path / "r").read().splitlines()[1:]] == ["c", "b", "a", "z"]


def test_variance_of_nearly_equal_ratios_at_great_depth(spark):
    """One part in 1e8 apart at a depth of 1e8: sums of squares would cancel to noise, in one bin or in many."""
    t = 10**8
    rows = [("2", 10 + 40 * k, "+", t // 2 + d, t, c, 3 * (1 - c) + i) for k in range(2) for c in (0, 1) for i, d in enumerate((0, 1, 3))]
    calls = spark.createDataFrame(rows, KINDS)
    (a, b) = D.site_moments(calls).collect()
    want = expected_variance([(0.5 + d / t, t) for d in (0, 1, 3)])
    assert np.allclose([a["variance_1"], b["variance_2"]], want, rtol=1e-6)
    regions = spark.createDataFrame([("x", "2", 1, 99)], "id string, contig string, start int, stop int")
    for size in (16, 10_000):
        r = D.differential_regions(calls, regions, DICT.frame(spark), bin_size=size).first()
        assert r["t_statistic"] == 0 and r["p_value"] == 1 and abs(r["sample1_mean"] - 0.5 - 4e-8 / 3) < 1e-15


def expected_variance(x):
    v, w = (np.array(c, dtype=np.longdouble) for c in zip(*x, strict=True))
    m = (v * w).sum() / w.sum()
    return float(w.sum() / (w.sum() ** 2 - (w * w).sum()) * (w * (v - m) ** 2).sum())


@pytest.mark.parametrize("bin_size", [1, 3, 16_384])
def test_a_region_is_few_bins_that_do_not_overlap(spark, bin_size):
    rng = np.random.default_rng(bin_size)
    top = bin_size * D.FAN**D.LEVELS
    spans = [(0, top), (5, 5), (bin_size, 2 * bin_size - 1), (0, 8 * bin_size - 1), (1, 8 * bin_size)]
    spans += [tuple(sorted(int(x) for x in rng.integers(0, n, 2))) for n in (50, 10 * bin_size, 100 * bin_size, 5_000 * bin_size, top // 2) for _ in range(30)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, start long, stop long")
    held = {}
    for r in df.select("i", F.inline(D._covering(bin_size))).collect():
        held.setdefault(r["i"], []).append((r["_bin"] * bin_size * D.FAN ** r["_level"], (r["_bin"] + 1) * bin_size * D.FAN ** r["_level"], r["_level"]))
    for i, (a, b) in enumerate(spans):
        bins = sorted(held[i])
        assert bins[0][0] == a // bin_size * bin_size and bins[-1][1] == (b // bin_size + 1) * bin_size
        assert all(x[1] == y[0] for x, y in zip(bins, bins[1:]))
        assert all(sum(x[2] == k for x in bins) < 2 * D.FAN for k in range(D.LEVELS - 1))


def test_whole_chromosomes_and_points_meet_their_calls_once(spark):
    calls = spark.range(0, 200_000, 1, 4).select(F.lit("2").alias("contig"), (F.col("id") * 1000 + 1).cast("int").alias("position"))
    regions = spark.createDataFrame([("all", "2", 1, 249_000_000), ("point", "2", 5_001, 5_001), ("none", "2", 5_002, 5_003), ("half", "2", 70_000_000, 140_000_001)], "id string, contig string, start int, stop int")
    got = {r["id"]: (r["n"], r["d"]) for r in D.region_calls(calls, regions).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d")).collect()}
    assert got == {"all": (200_000, 200_000), "point": (1, 1), "half": (70_001, 70_001)}


def test_sums_merge_before_the_shuffle(spark):
    rows = [("2", 1 + i % 3, "+", i % 5, 9, i % 2, i) for i in range(60)]
    plan = D.site_moments(spark.createDataFrame(rows, KINDS))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan and plan.count("Exchange") == 1


def test_counts_whose_squares_are_no_longs(spark):
    t = 9_000_000_000
    rows = [("2", 1, "+", t // 2 + d, t, c, i) for c in (0, 1) for i, d in enumerate((0, 1_000, 30_000))]
    r = D.site_moments(spark.createDataFrame(rows, KINDS.replace("methylated int, total int", "methylated long, total long"))).first()
    want = expected_variance([(0.5 + d / t, t) for d in (0, 1_000, 30_000)])
    assert np.allclose([r["variance_1"], r["variance_2"]], want, rtol=1e-6)


def test_sites_of_depth_zero_have_no_moments(spark):
    rows = [("2", 1, "+", 0, 0, 0, 0), ("2", 1, "+", 1, 4, 0, 1), ("2", 1, "+", 1, 4, 1, 2), ("2", 1, "+", 2, 8, 1, 3)]
    r = D.site_moments(spark.createDataFrame(rows, KINDS), 0).first()
    assert math.isnan(r["mean_1"]) and (r["mean_2"], r["variance_2"]) == (0.25, 0.0)
