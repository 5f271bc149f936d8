"""Methylation data derived from the driver tables, in whole numbers, so that any SQL engine derives the same.

Regions of the world are contigs, line items are calls of six samples, suppliers are
genomic regions, and orders are aligned reads whose calls come from an MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calls import merge_calls
from ..operators.dictionary import SequenceDictionary

CONTROL = "AFRICA"
CONTIG_LENGTH = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contig(spark: SparkSession, sf_dir: str, df: DataFrame, key: str) -> DataFrame:
    """``df`` with the contig of the region whose number is ``key`` modulo five."""
    names = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("_r"), F.col("r_name").alias("contig"))
    return df.withColumn("_r", F.col(key) % 5).join(F.broadcast(names), "_r").drop("_r")  # five rows


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region")
    order = F.col("r_regionkey").cast("int")
    return region.select(
        F.col("r_name").alias("contig"), F.lit(CONTIG_LENGTH).alias("length"), order.alias("contig_order"),
        (F.col("r_name") == CONTROL).alias("is_control"), (order.cast("long") * CONTIG_LENGTH).alias("contig_offset"),
    )


def sequence_dictionary(spark: SparkSession, sf_dir: str, controls: tuple[str, ...] = (CONTROL,)) -> SequenceDictionary:
    """The same five contigs as the header of a file would have them."""
    names = [r["r_name"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").limit(5).collect()]
    return SequenceDictionary(tuple((n, CONTIG_LENGTH) for n in names), controls)


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _contig(spark, sf_dir, _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount"), "l_partkey")
    sample, total = (F.col("l_suppkey") % 6).cast("int"), F.col("l_quantity").cast("int")
    return items.select(
        sample.alias("sample_id"), (sample < 3).cast("int").alias("condition"), "contig", (F.col("l_partkey") + 1).cast("int").alias("position"),
        F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.floor(total * F.round(F.col("l_discount") * 100).cast("int") / 10).cast("int").alias("methylated"), total.alias("total"),
    )


def sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call by sample and site, as a call file would have it."""
    raw = raw_calls(spark, sf_dir)
    merged = raw.groupBy("sample_id", "condition", "contig", "position").agg(
        F.min("strand").alias("strand"), F.sum("methylated").alias("methylated"), F.sum("total").alias("total")
    )
    return merged


def ratio_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample calls with their ratios."""
    return sample_calls(spark, sf_dir).withColumn("ratio", F.col("methylated").cast("double") / F.col("total"))


def merged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_calls(raw_calls(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contig(spark, sf_dir, _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    start = F.col("s_suppkey") * 25 + 1
    return own.select(
        F.col("s_name").alias("id"), "contig", start.cast("int").alias("start"), (start + 249).cast("int").alias("stop"), F.col("s_suppkey").alias("region_ordinal")
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 2k and 2k+1 are mates that overlap."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey").withColumn("n", F.floor(F.col("o_orderkey") / 2).cast("long"))
    # the orders are one small file, and a read is many rows later: a number of parts that is not merged for its few bytes;
    # by ranges of the key, so that a file of reads in its order needs no second shuffle
    own = _contig(spark, sf_dir, orders.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey"), "n")
    key = F.col("o_orderkey")
    return own.select(
        F.concat(F.lit("read"), F.col("n").cast("string")).alias("qname"), F.lit(3).alias("flag"), "contig",
        (F.col("n") % 1500 + 1 + 10 * (key % 2)).cast("int").alias("start"),
        F.when(key % 3 == 0, "32M").when(key % 3 == 1, "10M2I20M").otherwise("10M3D22M").alias("cigar"),
        F.translate(F.md5(key.cast("string")), "0123456789abcdef", "zZxXhHuU........").alias("xm"),
        F.when(F.col("n") % 2 == 0, "CT").otherwise("GA").alias("xg"), key.alias("ordinal"),
    )


#: Depth of the six tracks. Their sums and ratios have no decimal ties, so that engines agree on printed numbers.
TRACK_DEPTHS = (7, 14, 21, 9, 18, 36)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six samples with a call at every site, each of a depth that is its own."""
    k, depth = F.col("sample_id"), F.get(F.array(*[F.lit(n) for n in TRACK_DEPTHS]), F.col("sample_id"))
    sites = merged_calls(spark, sf_dir).select("contig", "position", "strand", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("sample_id"))
    return sites.withColumns({"methylated": ((F.col("position") * (2 * k + 5) + k) % (depth + 1)).cast("int"), "total": depth})


def mixed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads`` in which the names and flags of seven pairs in a row are: two single reads; an unmapped read and its
    mate; a read and its unmapped mate; four records of one name, the first unmapped; and two pairs."""
    n, odd = F.floor(F.col("ordinal") / 2).cast("long"), F.col("ordinal") % 2 == 1
    kind = n % 7
    flag = (
        F.when(kind == 0, 0)
        .when(kind == 1, F.when(odd, 9).otherwise(5))
        .when(kind == 2, F.when(odd, 5).otherwise(9))
        .when((kind == 3) & ~odd, 5)
        .otherwise(3)
    )
    unmapped = flag.bitwiseAND(4) != 0
    own = reads(spark, sf_dir).withColumn("flag", flag)
    return own.withColumns({
        "qname": F.when(kind.isin(3, 4), F.concat(F.lit("four"), F.floor(n / 7).cast("string"))).otherwise(F.col("qname")),
        "contig": F.when(unmapped, "*").otherwise(F.col("contig")),
    })
