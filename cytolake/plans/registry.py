"""The registered queries of the methylation engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import corrected_ratio, ratio, safe_div
from ..operators import calls as C
from ..operators import differential as D
from ..operators import extract as X
from ..operators.coordinates import from_linear
from ..operators.dictionary import bin_of, linear_position, precedes, with_contigs
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ERROR, DEPTH, CHUNK = 0.05, 20, 100_000


def rounded(c: Column | str, digits: int = 6) -> Column:
    """NaN as null and few digits, so that engines agree on the bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits))


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# --- SQL that several queries share -------------------------------------------

RAW = """raw AS (
  SELECT (l_suppkey % 6)::INT AS sample_id, (l_suppkey % 6 < 3)::INT AS condition, r_name AS contig, r_regionkey AS contig_order,
         (l_partkey + 1)::INT AS position, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         l_quantity::INT * round(l_discount * 100)::INT // 10 AS methylated, l_quantity::INT AS total
  FROM lineitem JOIN region ON r_regionkey = l_partkey % 5
)"""
SAMPLES = RAW + """, samples AS (
  SELECT sample_id, condition, contig, contig_order, position, min(strand) AS strand,
         sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total
  FROM raw GROUP BY sample_id, condition, contig, contig_order, position
)"""


def moments_sql(source: str, keys: str, extra: str = "") -> str:
    """CTEs of weighted means and two-pass variances by ``keys`` from ``source`` (with condition, v, w)."""
    on = " AND ".join(f"o.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""means AS (
  SELECT {keys}, CASE WHEN condition = 0 THEN 1 ELSE 2 END AS g, count(*) AS n, sum(w * v) / sum(w) AS mean,
         sum(w) AS sw, sum(w * w) AS sw2, min(v) AS lo, max(v) AS hi
  FROM {source} GROUP BY {keys}, g
), spread AS (
  SELECT {", ".join("m." + k.strip() for k in keys.split(","))}, m.g, any_value(n) AS n, any_value(mean) AS mean,
         CASE WHEN any_value(lo) = any_value(hi) THEN 0.0 ELSE sum(w * (v - mean) * (v - mean)) END AS ss, any_value(sw) AS sw, any_value(sw2) AS sw2
  FROM {source} o JOIN means m ON {on} AND m.g = CASE WHEN o.condition = 0 THEN 1 ELSE 2 END
  GROUP BY {", ".join("m." + k.strip() for k in keys.split(","))}, m.g
), moments AS (
  SELECT {keys}, coalesce(max(n) FILTER (g = 1), 0) AS n_1, max(mean) FILTER (g = 1) AS mean_1,
         max(CASE WHEN sw * sw = sw2 THEN 'NaN'::DOUBLE ELSE sw / (sw * sw - sw2) * ss END) FILTER (g = 1) AS variance_1,
         coalesce(max(n) FILTER (g = 2), 0) AS n_2, max(mean) FILTER (g = 2) AS mean_2,
         max(CASE WHEN sw * sw = sw2 THEN 'NaN'::DOUBLE ELSE sw / (sw * sw - sw2) * ss END) FILTER (g = 2) AS variance_2{extra}
  FROM spread GROUP BY {keys}
)"""


#: Terms of the continued fraction in SQL: four times what the engine takes, and with the database's own gamma function.
SQL_TERMS = 200


def _fraction_sql(a: str, b: str, x: str, y: str) -> str:
    even = f"floor(k / 2) * ({b} - floor(k / 2)) * {x} / (({a} + 2 * floor(k / 2) - 1) * ({a} + 2 * floor(k / 2)))"
    odd = f"-({a} + floor(k / 2)) * ({a} + {b} + floor(k / 2)) * {x} / (({a} + 2 * floor(k / 2)) * ({a} + 2 * floor(k / 2) + 1))"
    tail = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({SQL_TERMS}, 0, -1), lambda z: z::DOUBLE)), lambda acc, k: 1.0 + (CASE WHEN k::BIGINT % 2 = 0 THEN {even} ELSE {odd} END) / acc)"
    return f"exp({a} * ln({x}) + {b} * ln({y}) - lb) / ({a} * {tail})"


#: Adds the test to a relation ``moments``; tests of fewer than two observations are null.
TEST_SQL = f"""pooled AS (
  SELECT *, variance_1 / n_1 AS va, variance_2 / n_2 AS vb FROM moments
), w AS (
  SELECT *, CASE WHEN va + vb = 0 THEN CASE WHEN mean_1 = mean_2 THEN 'NaN'::DOUBLE WHEN mean_1 > mean_2 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END
              ELSE (mean_1 - mean_2) / sqrt(va + vb) END AS t,
         CASE WHEN va + vb = 0 THEN 'NaN'::DOUBLE ELSE (va + vb) * (va + vb) / (va * va / (n_1 - 1) + vb * vb / (n_2 - 1)) END AS df
  FROM pooled WHERE n_1 > 1 AND n_2 > 1
), xy AS (
  SELECT *, df / (df + t * t) AS x, t * t / (df + t * t) AS y, df / 2 AS a, 0.5::DOUBLE AS h,
         lgamma(df / 2) + lgamma(0.5) - lgamma(df / 2 + 0.5) AS lb
  FROM w
), tested AS (
  SELECT *, CASE WHEN isnan(df) OR isnan(t) THEN 'NaN'::DOUBLE WHEN isinf(t) THEN 0.0 WHEN t = 0 THEN 1.0
                 WHEN x <= (a + 1) / (a + 2.5) THEN {_fraction_sql("a", "h", "x", "y")} ELSE 1 - {_fraction_sql("h", "a", "y", "x")} END AS p
  FROM xy
)"""


# --- queries ------------------------------------------------------------------


@query(f"WITH {RAW} SELECT sample_id, contig, position, strand, methylated, total, round(methylated / total, 6) AS ratio FROM raw")
def scan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.raw_calls(spark, sf_dir)
    return raw.select("sample_id", "contig", "position", "strand", "methylated", "total", rounded(ratio(F.col("methylated"), F.col("total"))).alias("ratio"))


@query(
    f"""WITH {RAW} SELECT contig, position, arg_min(strand, sample_id) AS strand, sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total
FROM raw GROUP BY contig, position ORDER BY min(contig_order), position"""
)
def merge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ordered(C.merge_calls(V.raw_calls(spark, sf_dir)), V.dictionary(spark, sf_dir))


@query(f"WITH {RAW} SELECT round(sum(methylated) / sum(total), 9) AS error_rate FROM raw WHERE contig = 'AFRICA'")
def control_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = C.control_error_rate(V.raw_calls(spark, sf_dir), V.dictionary(spark, sf_dir), ERROR)
    return rate.select(rounded("error_rate", 9).alias("error_rate"))


@query(
    f"""WITH {RAW}, merged AS (
  SELECT contig, position, min(strand) AS strand, sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total FROM raw GROUP BY contig, position
), e AS (SELECT sum(methylated) / sum(total) AS e FROM merged WHERE contig = 'AFRICA')
SELECT contig, position, strand, methylated, total, round(greatest(0.0, (methylated / total - e) / (1 - e)), 6) AS ratio
FROM merged, e WHERE contig <> 'AFRICA'"""
)
def consensus_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = C.consensus_call(V.merged_calls(spark, sf_dir), V.dictionary(spark, sf_dir), ERROR)
    return called.withColumn("ratio", rounded("ratio"))


@query(
    f"""WITH {SAMPLES} SELECT contig, position, arg_min(strand, sample_id) AS strand, round(avg(methylated / total), 6) AS ratio,
round(stddev_samp(methylated / total) / sqrt(count(*)), 6) AS standard_deviation
FROM samples WHERE total >= {DEPTH} GROUP BY contig, position HAVING count(*) >= 2"""
)
def population_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.population_call(V.ratio_calls(spark, sf_dir), DEPTH)
    return out.withColumns({c: rounded(c) for c in ("ratio", "standard_deviation")})


SITES = f"""{SAMPLES}, obs AS (SELECT contig, position, condition, strand, methylated / total AS v, total::DOUBLE AS w FROM samples WHERE total >= 3), """


@query(
    f"""WITH {SITES} {moments_sql("obs", "contig, position")}
SELECT contig, position, CASE WHEN position % 2 = 1 THEN '+' ELSE '-' END AS strand, n_1, round(mean_1, 6) AS mean_1,
round(CASE WHEN NOT isnan(variance_1) THEN variance_1 END, 6) AS variance_1, n_2, round(mean_2, 6) AS mean_2,
round(CASE WHEN NOT isnan(variance_2) THEN variance_2 END, 6) AS variance_2 FROM moments"""
)
def site_weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.site_moments(V.sample_calls(spark, sf_dir))
    return out.withColumns({c: rounded(c) for c in ("mean_1", "variance_1", "mean_2", "variance_2")})


def _statistics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in ("sample1_mean", "sample2_mean", "t_statistic", "p_value")})


@query(
    f"""WITH {SITES} {moments_sql("obs", "contig, position")}, {TEST_SQL}
SELECT contig, position, CASE WHEN position % 2 = 1 THEN '+' ELSE '-' END AS strand, round(mean_1, 6) AS sample1_mean,
round(mean_2, 6) AS sample2_mean, round(t, 6) AS t_statistic, round(p, 6) AS p_value FROM tested WHERE NOT isnan(p) AND p <= 0.05"""
)
def differential_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(D.differential_sites(V.sample_calls(spark, sf_dir)))


REGIONS = """regions AS (
  SELECT s_name AS id, r_name AS contig, (s_suppkey * 25 + 1)::INT AS start, (s_suppkey * 25 + 250)::INT AS stop
  FROM supplier JOIN region ON r_regionkey = s_suppkey % 5
)"""


@query(
    f"""WITH {SAMPLES}, {REGIONS} SELECT id, start, stop, s.contig, position, sample_id, methylated, total
FROM samples s JOIN regions r ON s.contig = r.contig AND position BETWEEN start AND stop"""
)
def region_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.region_calls(V.sample_calls(spark, sf_dir), V.regions(spark, sf_dir), 128)
    return found.select("id", "start", "stop", "contig", "position", "sample_id", "methylated", "total")


@query(
    f"""WITH {SAMPLES}, {REGIONS}, obs AS (
  SELECT id, condition, methylated / total AS v, total::DOUBLE AS w
  FROM samples s JOIN regions r ON s.contig = r.contig AND position BETWEEN start AND stop WHERE total >= 3
), {moments_sql("obs", "id")}, {TEST_SQL}
SELECT r.id, r.contig, r.start, r.stop, round(mean_1, 6) AS sample1_mean, round(mean_2, 6) AS sample2_mean, round(t, 6) AS t_statistic,
round(CASE WHEN NOT isnan(p) THEN p END, 6) AS p_value FROM regions r LEFT JOIN tested t ON t.id = r.id"""
)
def differential_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.differential_regions(V.sample_calls(spark, sf_dir), V.regions(spark, sf_dir), V.dictionary(spark, sf_dir), bin_size=128)
    return _statistics(out.drop("region_ordinal"))


READS = """reads AS (
  SELECT o_orderkey AS ordinal, o_orderkey // 2 AS n, r_name AS contig, ((o_orderkey // 2) % 1500 + 1 + 10 * (o_orderkey % 2))::INT AS start,
         o_orderkey % 3 AS shape, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'zZxXhHuU........') AS xm,
         CASE WHEN (o_orderkey // 2) % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM orders JOIN region ON r_regionkey = (o_orderkey // 2) % 5
), walked AS (
  SELECT *, substr(xm, k::INT, 1) AS call,
         CASE shape WHEN 0 THEN start + k - 1
                    WHEN 1 THEN CASE WHEN k <= 10 THEN start + k - 1 WHEN k > 12 THEN start + k - 3 END
                    ELSE CASE WHEN k <= 10 THEN start + k - 1 ELSE start + k + 2 END END AS position
  FROM reads, unnest(range(1, 33)) AS u(k)
), kept AS (SELECT * FROM walked WHERE position IS NOT NULL AND call <> '.')"""
COUNTED = """SELECT CASE upper(call) WHEN 'H' THEN 'CHH' WHEN 'X' THEN 'CHG' WHEN 'Z' THEN 'CpG' ELSE 'CN_CHN' END AS context,
  contig, position::INT AS position, strand, sum((call = upper(call))::INT)::BIGINT AS methylated, count(*) AS total"""
MATES = """mates AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY start, ordinal) AS mate,
         start + CASE shape WHEN 0 THEN 32 WHEN 1 THEN 30 ELSE 35 END AS after
  FROM reads
), firsts AS (SELECT n, start, after, ordinal FROM mates WHERE mate = 1)"""
PAIRED = f"""{READS}, {MATES}, counts AS (
  {COUNTED} FROM kept JOIN firsts USING (n)
  WHERE kept.ordinal = firsts.ordinal OR kept.position >= kept.start + greatest(0, firsts.after - kept.start) GROUP BY 1, 2, 3, 4
)"""


@query(f"WITH {READS} {COUNTED} FROM kept GROUP BY 1, 2, 3, 4")
def extract_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(V.reads(spark, sf_dir), paired=False)


@query(f"WITH {PAIRED} SELECT * FROM counts")
def extract_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(V.reads(spark, sf_dir))


@query(f"WITH {PAIRED} SELECT context, count(*) AS sites, sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total FROM counts GROUP BY context")
def extract_context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(V.reads(spark, sf_dir)).groupBy("context").agg(
        F.count("*").alias("sites"), F.sum("methylated").alias("methylated"), F.sum("total").alias("total")
    )


@query(
    f"""WITH {PAIRED} SELECT coalesce(contig, 'All') AS contig, round(sum(total) / count(*), 6) AS depth,
round(sum(methylated) / sum(total), 6) AS methylation_ratio FROM counts GROUP BY ROLLUP (contig)"""
)
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.extract_summary(X.extract(V.reads(spark, sf_dir)), V.dictionary(spark, sf_dir))
    return out.select("contig", rounded("depth").alias("depth"), rounded("methylation_ratio").alias("methylation_ratio"))


@query(f"WITH {READS}, {MATES} SELECT a.ordinal AS first, b.ordinal AS second FROM mates a LEFT JOIN mates b ON a.n = b.n AND b.mate = 2 WHERE a.mate = 1")
def mate_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fragments(V.reads(spark, sf_dir)).select(F.col("first.ordinal").alias("first"), F.col("second.ordinal").alias("second"))


@query(
    f"""WITH {RAW} SELECT contig, position, (contig_order * 1000000 + position)::BIGINT AS linear_position,
contig_order < 2 OR (contig_order = 2 AND position <= 1000) AS in_front FROM raw GROUP BY contig, position, contig_order"""
)
def linear_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = with_contigs(V.raw_calls(spark, sf_dir).select("contig", "position").distinct(), V.dictionary(spark, sf_dir))
    front = precedes(F.col("contig_order"), F.col("position"), F.lit(2), F.lit(1000))
    return sites.select("contig", "position", linear_position(F.col("contig_offset"), F.col("position")).alias("linear_position"), front.alias("in_front"))


@query("SELECT o_orderkey, r_name AS contig, (o_orderkey % 4999999 % 1000000 + 1)::INT AS position FROM orders JOIN region ON r_regionkey = o_orderkey % 4999999 // 1000000")
def inverse_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 4_999_999 + 1).alias("linear_position"))
    return from_linear(orders, V.dictionary(spark, sf_dir)).drop("linear_position")


@query(
    f"""WITH {RAW} SELECT ((contig_order * 1000000 + position) // {CHUNK})::BIGINT AS bin, count(*) AS calls, sum(total)::BIGINT AS total
FROM raw GROUP BY 1"""
)
def genome_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_contigs(V.raw_calls(spark, sf_dir), V.dictionary(spark, sf_dir))
    at = bin_of(linear_position(F.col("contig_offset"), F.col("position")), CHUNK)
    return placed.groupBy(at.alias("bin")).agg(F.count("*").alias("calls"), F.sum("total").alias("total"))


@query(
    """SELECT l_quantity AS a, l_discount AS b, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS quotient,
round(greatest(0.0, (l_discount - 0.05) / (1 - 0.05)), 6) AS corrected FROM lineitem"""
)
def ratio_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division and correction at the edges: a quotient by zero is infinite here, and null in the result."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = safe_div(F.col("l_quantity"), F.col("l_discount"))
    fixed = corrected_ratio(F.col("l_discount"), F.lit(1.0), F.lit(0.05))
    return items.select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.when(q != float("inf"), rounded(q)).alias("quotient"), rounded(fixed).alias("corrected"))
