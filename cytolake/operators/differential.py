"""Differential methylation between two conditions, by site and by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import count_sums, two_tailed_p, with_moments, with_parts, with_welch
from ..schema import SIGNIFICANCE, TEST_DEPTH
from .calls import first_strand

#: Bases in a bin of the interval join on its first level, how many bins make one of the next level, and levels.
BIN, FAN, LEVELS = 16_384, 8, 6


def _observed() -> list[Column]:
    m, t, one = F.col("methylated"), F.col("total"), F.col("condition") == 0
    return [*count_sums(m, t, one, "_1"), *count_sums(m, t, ~one, "_2")]


def _parts(groups: DataFrame) -> DataFrame:
    """``part_1`` and ``part_2`` instead of the sums."""
    return with_parts(groups, {"part_1": "_1", "part_2": "_2"})


def _by_site(calls: DataFrame, min_depth: int, least: int = 0) -> DataFrame:
    """Sites with ``least`` observations or more in both conditions."""
    covered = calls.where(F.col("total") >= min_depth)
    sites = covered.groupBy("contig", "position").agg(first_strand(calls), *_observed())
    return _parts(sites.where((F.col("_1n") >= least) & (F.col("_2n") >= least)) if least else sites)


def tested(groups: DataFrame, keep: list[str]) -> DataFrame:
    """The test where both conditions have two observations or more; nulls elsewhere."""
    done = with_welch(with_moments(groups, keep))
    enough = (F.col("n_1") > 1) & (F.col("n_2") > 1)
    found = {"sample1_mean": "mean_1", "sample2_mean": "mean_2", "t_statistic": "t", "_df": "df"}
    out = done.select(*keep, *[F.when(enough, F.col(c)).alias(n) for n, c in found.items()])
    return out.withColumn("p_value", two_tailed_p(F.col("t_statistic"), F.col("_df"))).drop("_df")


def site_moments(calls: DataFrame, min_depth: int = TEST_DEPTH) -> DataFrame:
    """Weighted mean and variance of both conditions by site; condition 0 is sample 1, any other sample 2."""
    return with_moments(_by_site(calls, min_depth), ["contig", "position", "strand"])


def differential_sites(calls: DataFrame, min_depth: int = TEST_DEPTH, significance: float | None = SIGNIFICANCE) -> DataFrame:
    """contig, position, strand, sample1_mean, sample2_mean, t_statistic, p_value of significant sites.

    Calls of low depth are left out before they are shuffled. Where neither condition varies the
    p-value is NaN, and such a site is never significant, however far apart the means are.
    ``significance=None`` keeps every tested site."""
    out = tested(_by_site(calls, min_depth, 2), ["contig", "position", "strand"])
    return out if significance is None else only_significant(out, significance)


def only_significant(rows: DataFrame, significance: float) -> DataFrame:
    """A filter that stays where it is. A plain one would be pushed below the projections of the test, and its
    condition, with all steps put in, would be larger than the planner can take well; nothing below it could use it,
    since the p-value is made here. So the row in hand is filtered as an array of one."""
    kept = F.filter(F.array(F.struct(*rows.columns)), lambda r: ~F.isnan(r["p_value"]) & (r["p_value"] <= significance))
    return rows.select(F.inline(kept))


def _run(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _covering(bin_size: int) -> Column:
    """Structs (_level, _bin) of bins that together hold a region and do not overlap: wide ones inside, narrow ones to its
    ends. A level has fewer than twice ``FAN`` of them, but for the last, whose bins are half a billion bases at the usual size."""
    out = []
    for level in range(LEVELS):
        first, last = F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size)
        low, high = F.ceil(first / FAN**level), F.floor((last + 1) / FAN**level) - 1
        if level == LEVELS - 1:
            runs = _run(low, high)
        else:
            up, down = F.ceil(first / FAN ** (level + 1)) * FAN, F.floor((last + 1) / FAN ** (level + 1)) * FAN
            runs = F.when(up < down, F.concat(_run(low, up - 1), _run(down, high))).otherwise(_run(low, high))
        out.append(F.transform(runs, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_bin"))))
    return F.flatten(F.array(*out))


def region_calls(calls: DataFrame, regions: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Calls in regions, ends included: the region's id, start, stop and ordinal beside the call.

    Both sides meet by contig and bin, on several levels of bins each eight times as wide. A region is a few bins of each
    level, and a call is in one of its bins at most, so a match is found once; calls look on those levels alone that
    some region uses. Where a wide region makes a bin hot, its calls are split by the engine's skew join."""
    spread = regions.where("start <= stop").select("*", F.inline(_covering(bin_size)))
    used = sorted(r["_level"] for r in spread.select("_level").distinct().collect())  # LEVELS rows at most
    at = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col("position") / F.lit(bin_size * FAN**k)).alias("_bin")) for k in used or [0]])
    placed = calls.select("*", F.inline(at))
    return placed.join(spread, ["contig", "_level", "_bin"]).where("position between start and stop").drop("_level", "_bin")


def with_ordinals(regions: DataFrame) -> DataFrame:
    """Regions with ``region_ordinal``, their place in the input, which tells equal regions apart."""
    return regions if "region_ordinal" in regions.columns else regions.withColumn("region_ordinal", F.monotonically_increasing_id())


def differential_regions(calls: DataFrame, regions: DataFrame, dictionary: DataFrame, min_depth: int = TEST_DEPTH, bin_size: int = BIN) -> DataFrame:
    """id, contig, start, stop, sample1_mean, sample2_mean, t_statistic, p_value, region_ordinal of every
    region on a contig of the dictionary.

    All observations of a region are pooled. A region where a condition has fewer than two has nulls;
    NaN is kept, so that a missing test and one without variance stay apart."""
    known = with_ordinals(regions).join(dictionary.select("contig"), "contig", "left_semi")
    covered = calls.where(F.col("total") >= min_depth).select("contig", "position", "condition", "methylated", "total")
    # sums of a region's calls, made before they are shuffled
    pooled = _parts(region_calls(covered, known, bin_size).groupBy("region_ordinal").agg(*_observed()))
    whole = known.join(pooled, "region_ordinal", "left")
    return tested(whole.select("id", "contig", "start", "stop", "region_ordinal", "part_1", "part_2"), ["id", "contig", "start", "stop", "region_ordinal"])
