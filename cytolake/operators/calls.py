"""Merging, correcting and averaging calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import corrected_ratio
from ..schema import POPULATION_DEPTH
from .dictionary import with_contigs  # noqa: F401  (verbs use it from here too)


def union_samples(samples: list[DataFrame], conditions: list[int] | None = None) -> DataFrame:
    """Many inputs as one frame with ``sample_id`` and, if given, ``condition``."""
    if conditions is not None and len(conditions) != len(samples):
        raise ValueError("as many conditions as inputs are needed")
    marked = [
        s.withColumns({"sample_id": F.lit(i)} | ({"condition": F.lit(conditions[i])} if conditions else {}))
        for i, s in enumerate(samples)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def first_strand(calls: DataFrame) -> Column:
    """The strand that a site has where it is seen first: in the first input, at its first row."""
    order = [F.col(c) for c in ("sample_id", "ordinal") if c in calls.columns] or [F.col("strand")]
    return F.min_by("strand", F.struct(*order)).alias("strand")


def merge_calls(calls: DataFrame) -> DataFrame:
    """Counts of co-located calls added up: contig, position, strand, methylated, total. Ratios are dropped."""
    return calls.groupBy("contig", "position").agg(
        first_strand(calls), F.sum(F.col("methylated").cast("long")).alias("methylated"), F.sum(F.col("total").cast("long")).alias("total")
    )


def ordered(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows in genome order: contigs as the dictionary has them, then positions, then + before -."""
    strand = [F.when(F.col("strand") == "-", 1).otherwise(0)] if "strand" in df.columns else []
    return with_contigs(df, dictionary).orderBy("contig_order", "position", *strand).select(*df.columns)


def control_error_rate(calls: DataFrame, dictionary: DataFrame, default: float = 0.0) -> DataFrame:
    """One row: the share of methylated reads on control contigs, or ``default`` without any reads there."""
    control = with_contigs(calls, dictionary).where("is_control")
    m, t = F.sum(F.col("methylated").cast("long")), F.sum(F.col("total").cast("long"))
    return control.agg(F.when(t > 0, m.cast("double") / t).otherwise(F.lit(float(default))).alias("error_rate"))


def consensus_call(calls: DataFrame, dictionary: DataFrame, default_error: float = 0.0) -> DataFrame:
    """Calls outside control contigs with ``ratio`` corrected by the error rate of the control contigs."""
    rate = control_error_rate(calls, dictionary, default_error)
    wild = with_contigs(calls, dictionary).where(~F.col("is_control"))
    return (
        wild.join(F.broadcast(rate), how="cross")  # one row by construction
        .withColumn("ratio", corrected_ratio(F.col("methylated"), F.col("total"), F.col("error_rate")))
        .select("contig", "position", "strand", "methylated", "total", "ratio")
    )


def population_call(calls: DataFrame, min_depth: int = POPULATION_DEPTH) -> DataFrame:
    """Mean ratio over samples and its standard error, at sites that two samples or more cover.

    The mean is not weighted. A covered call without a ratio raises an error."""
    known = F.when(F.col("ratio").isNotNull(), F.col("ratio")).otherwise(F.raise_error(F.lit("a call has no ratio")).cast("double"))
    covered = calls.where(F.col("total") >= min_depth).withColumn("ratio", known)
    return (
        covered.groupBy("contig", "position")
        .agg(first_strand(calls), F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"), F.count("*").alias("n"))
        .where("n >= 2")
        .select("contig", "position", "strand", F.col("mean").alias("ratio"), (F.col("sd") / F.sqrt(F.col("n"))).alias("standard_deviation"))
    )
