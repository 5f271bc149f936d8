"""The verbs over sites: rows (contig, position, calls) with all calls of a site in hand, so that nothing is shuffled.

``calls`` has sample_id, condition, strand, methylated, total and ratio, in the order of the inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import corrected_ratio, ratio
from ..functions.stats import part
from ..schema import POPULATION_DEPTH, SIGNIFICANCE, TEST_DEPTH
from .differential import only_significant, tested


def _added(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, c: n + c[field])


def merge_sites(sites: DataFrame) -> DataFrame:
    """As ``merge_calls``."""
    c = F.col("calls")
    return sites.select("contig", "position", F.get(c, F.lit(0))["strand"].alias("strand"), _added(c, "methylated").alias("methylated"), _added(c, "total").alias("total"))


def site_calls(sites: DataFrame) -> DataFrame:
    """The calls themselves, a row each."""
    return sites.select("contig", "position", F.inline("calls"))


def control_error_rate(control: DataFrame, default: float = 0.0) -> DataFrame:
    """One row: the share of methylated reads in the sites of control contigs, or ``default`` without any reads there."""
    m, t = F.sum(_added(F.col("calls"), "methylated")), F.sum(_added(F.col("calls"), "total"))
    return control.agg(F.when(t > 0, m.cast("double") / t).otherwise(F.lit(float(default))).alias("error_rate"))


def consensus_sites(sites: DataFrame, error_rate: DataFrame) -> DataFrame:
    """The calls of sites outside control contigs, their ratios corrected; ``error_rate`` has one row. Plus comes before minus."""
    minus = lambda c: c["strand"] == "-"
    strands = sites.withColumn("calls", F.concat(F.filter("calls", lambda c: ~minus(c)), F.filter("calls", minus)))
    return (
        site_calls(strands).join(F.broadcast(error_rate), how="cross")  # one row by construction
        .withColumn("ratio", corrected_ratio(F.col("methylated"), F.col("total"), F.col("error_rate")))
        .select("contig", "position", "strand", "methylated", "total", "ratio")
    )


def population_sites(sites: DataFrame, min_depth: int = POPULATION_DEPTH) -> DataFrame:
    """As ``population_call``: means around which the squares are taken."""
    value = lambda c: F.when(c["ratio"].isNotNull(), c["ratio"]).otherwise(F.raise_error(F.lit("a call has no ratio")).cast("double"))
    covered = sites.withColumn("calls", F.filter("calls", lambda c: c["total"] >= min_depth)).where(F.size("calls") >= 1)
    known = covered.select("contig", "position", F.get(F.col("calls"), F.lit(0))["strand"].alias("strand"), F.transform("calls", value).alias("r"))
    # a call without a ratio is an error even where it is the only one
    checked = known.withColumn("n", F.size(F.filter("r", lambda x: x.isNotNull()))).where("n >= 2")
    means = checked.withColumn("mean", F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    squares = F.aggregate("r", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    return means.select("contig", "position", "strand", F.col("mean").alias("ratio"), (F.sqrt(squares / (F.col("n") - 1)) / F.sqrt(F.col("n"))).alias("standard_deviation"))


def _observed(chosen) -> Column:
    own = F.filter("calls", chosen)
    return F.transform(own, lambda c: F.struct(ratio(c["methylated"], c["total"]).alias("v"), c["total"].cast("double").alias("w")))


def differential_over_sites(sites: DataFrame, min_depth: int = TEST_DEPTH, significance: float | None = SIGNIFICANCE) -> DataFrame:
    """As ``differential_sites``."""
    covered = sites.withColumn("calls", F.filter("calls", lambda c: c["total"] >= min_depth))
    both = covered.select("contig", "position", F.get(F.col("calls"), F.lit(0))["strand"].alias("strand"), _observed(lambda c: c["condition"] == 0).alias("_1"), _observed(lambda c: c["condition"] != 0).alias("_2"))
    parts = both.where((F.size("_1") >= 2) & (F.size("_2") >= 2)).select("contig", "position", "strand", part(F.col("_1")).alias("part_1"), part(F.col("_2")).alias("part_2"))
    out = tested(parts, ["contig", "position", "strand"])
    return out if significance is None else only_significant(out, significance)
