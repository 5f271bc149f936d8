"""Registered queries that go through files: the command line writes them, the readers take them back.

Each writes its inputs from the driver tables into the shared folder, runs a verb, and returns what a reader
finds in the output, with the place of each row in the file. SQL has the same rows from the tables alone.
"""

from __future__ import annotations

import contextlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions.numeric import ratio
from ..functions.stats import close_to
from ..operators import calls as C
from ..operators import differential as D
from ..operators import extract as X
from ..operators import sites as S
from ..operators.coordinates import from_linear, genome_chunks, reference_length, region_length
from ..operators.dictionary import SequenceDictionary
from ..schema import CONSENSUS_PRAGMA, CONTEXT_FILES
from ..scratch import new_path
from ..sinks import write_bytes, write_call_files, write_calls, write_files, write_lines
from ..sources.alignments import open_alignments, read_alignments
from ..sources.bgzf import BLOCK, STRETCH
from ..sources.files import read_calls, read_consensus, read_regions, read_samples
from ..sources.lines import consecutive, lines
from ..sources.ranges import Bytes
from ..sources.sites import call_files, contig_ranges, read_sites, region_ranges
from . import views as V
from .registry import COUNTED, ORACLE, RAW, READS, TEST_SQL, moments_sql, query, rounded


def _numbered(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``df`` with ``place``, the rows counted from 0 along the file."""
    return consecutive(df, ordinal, "place")


def _body(spark: SparkSession, path: str, mark: str = "#") -> DataFrame:
    """(f, ordinal): the fields of a file's lines, its marked lines left out."""
    text = lines(spark, path).where(~F.startswith("value", F.lit(mark)))
    return text.select(F.split("value", "\t").alias("f"), F.col("line").alias("ordinal"))


def _track_files(spark: SparkSession, sf_dir: str, folder: str, with_ratio: bool, n: int = len(V.TRACK_DEPTHS)) -> list[str]:
    """The first ``n`` tracks as sorted call files."""
    paths = {f"track{k}": f"{folder}/track{k}.tab" for k in range(n)}
    calls = V.tracks(spark, sf_dir).where(F.col("sample_id") < n).withColumn("track", F.concat(F.lit("track"), F.col("sample_id").cast("string")))
    calls = calls.withColumn("ratio", ratio(F.col("methylated"), F.col("total"))) if with_ratio else calls
    write_call_files(calls, "track", paths, V.sequence_dictionary(spark, sf_dir))
    return list(paths.values())


def _inputs(paths: list[str]) -> list[str]:
    return [x for p in paths for x in ("-i", p)]


def _run(spark: SparkSession, *args: str) -> None:
    if cli.main(list(args), spark):
        raise RuntimeError(f"{args[0]} failed")


MERGED = RAW + """, merged AS (
  SELECT contig, contig_order, position, min(strand) AS strand, sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total
  FROM raw GROUP BY contig, contig_order, position
)"""
_DEPTH = " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(V.TRACK_DEPTHS))
TRACKS = f"""{MERGED}, tracks AS (
  SELECT k, contig, contig_order, position, strand, CASE k {_DEPTH} END AS total,
         (position * (2 * k + 5) + k) % (CASE k {_DEPTH} END + 1) AS methylated
  FROM merged, range(6) AS t(k)
)"""


# --- calls --------------------------------------------------------------------


@query(
    f"""WITH {TRACKS} SELECT contig, position, strand, sum(methylated)::INT AS methylated, sum(total)::INT AS total,
row_number() OVER (ORDER BY contig_order, position) - 1 AS place FROM tracks GROUP BY contig, contig_order, position, strand"""
)
def cli_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six call files of five columns merged into one, which is in genome order."""
    folder = new_path(spark, "merge")
    paths = _track_files(spark, sf_dir, folder, False)
    _run(spark, "merge", *_inputs(paths), "--output", f"{folder}/out.tab")
    return _numbered(read_calls(spark, f"{folder}/out.tab")[0].drop("ratio"))


CALLED = """SELECT contig, position, strand, methylated::INT AS methylated, total::INT AS total,
format('{{:.4f}}', greatest(0.0, (methylated / total - e) / (1 - e)))::DOUBLE AS ratio, row_number() OVER (ORDER BY contig_order, position) - 1 AS place"""


def _called(spark: SparkSession, sf_dir: str, controls: tuple[str, ...]) -> DataFrame:
    folder = new_path(spark, "call")
    write_calls(V.merged_calls(spark, sf_dir), f"{folder}/in.tab", V.sequence_dictionary(spark, sf_dir, controls))
    _run(spark, "call", "--input", f"{folder}/in.tab", "--output", f"{folder}/out.tab", "--error", "0.125")
    return _numbered(read_calls(spark, f"{folder}/out.tab")[0])


@query(
    f"""WITH {MERGED}, rate AS (SELECT sum(methylated) / sum(total) AS e FROM merged WHERE contig = 'AFRICA')
{CALLED.format()} FROM merged, rate WHERE contig <> 'AFRICA'"""
)
def cli_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios corrected by the control contig, printed with four decimals."""
    return _called(spark, sf_dir, (V.CONTROL,))


@query(f"""WITH {MERGED}, rate AS (SELECT 0.125::DOUBLE AS e) {CALLED.format()} FROM merged, rate""")
def cli_call_default_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a control contig the given error rate corrects."""
    return _called(spark, sf_dir, ())


@query(
    f"""WITH {TRACKS}, printed AS (
  SELECT *, format('{{:.4f}}', methylated / total)::DOUBLE AS r FROM tracks WHERE k < 3
) SELECT contig, position, strand, format('{{:.4f}}', avg(r))::DOUBLE AS ratio, format('{{:.4f}}', stddev_samp(r) / sqrt(count(*)))::DOUBLE AS standard_deviation,
row_number() OVER (ORDER BY contig_order, position) - 1 AS place FROM printed GROUP BY contig, contig_order, position, strand"""
)
def cli_popcall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three call files with ratios averaged, and the standard error."""
    folder = new_path(spark, "popcall")
    paths = _track_files(spark, sf_dir, folder, True, 3)
    _run(spark, "popCall", *_inputs(paths), "--output", f"{folder}/out.tab", "--cutoff", "7")
    f = F.col("f")
    body = _body(spark, f"{folder}/out.tab").select(
        f[0].alias("contig"), f[1].cast("int").alias("position"), f[2].alias("strand"), f[3].cast("double").alias("ratio"), f[4].cast("double").alias("standard_deviation"), "ordinal"
    )
    return _numbered(body)


def _statistics(at: int) -> list[Column]:
    """Means, t and p of a line; p in fewer digits, NA as null."""
    f = lambda i: F.when(F.col("f")[i] != "NA", F.col("f")[i]).cast("double")
    return [f(at).alias("sample1_mean"), f(at + 1).alias("sample2_mean"), f(at + 2).alias("t_statistic"), rounded(f(at + 3)).alias("p_value")]


def _three_digits(x: str) -> str:
    power = f"pow(10, 2 - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 OR {x} IS NULL OR isinf({x}) THEN {x} ELSE round({x} * {power}) / {power} END"


OBSERVED = f"""{TRACKS}, obs AS (SELECT contig, contig_order, position, strand, (k < 3)::INT AS condition, methylated / total AS v, total::DOUBLE AS w FROM tracks), """
PRINTED = f"""{_three_digits("mean_1")} AS sample1_mean, {_three_digits("mean_2")} AS sample2_mean, {_three_digits("t")} AS t_statistic"""


@query(
    f"""WITH {OBSERVED} {moments_sql("obs", "contig, contig_order, position, strand")}, {TEST_SQL}
SELECT contig, position, strand, {PRINTED}, round(p, 6) AS p_value, row_number() OVER (ORDER BY contig_order, position) - 1 AS place
FROM tested WHERE NOT isnan(p) AND p <= 0.05"""
)
def cli_diff_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six call files tested by site; statistics are printed with three digits."""
    folder = new_path(spark, "diff")
    paths = _track_files(spark, sf_dir, folder, False)
    _run(spark, "diff", *_inputs(paths), "--output", f"{folder}/out.tab", "--conditions", "1,1,1,0,0,0")
    f = F.col("f")
    body = _body(spark, f"{folder}/out.tab", "Contig\t").select(f[0].alias("contig"), f[1].cast("int").alias("position"), f[2].alias("strand"), *_statistics(3), "ordinal")
    return _numbered(body)


WIDE_REGIONS = """regions AS (
  SELECT s_name AS id, CASE WHEN s_suppkey % 10 = 9 THEN 'ATLANTIS' WHEN s_suppkey % 10 = 8 THEN 'ASIA' ELSE r_name END AS contig, s_suppkey,
         CASE WHEN s_suppkey % 10 = 8 THEN 900001 ELSE (s_suppkey * 25 + 1)::INT END AS start,
         CASE WHEN s_suppkey % 10 = 8 THEN 900050 ELSE (s_suppkey * 25 + 250)::INT END AS stop
  FROM supplier JOIN region ON r_regionkey = s_suppkey % 5
)"""


def _region_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The suppliers' regions, of which one in ten is on a contig that no dictionary has, and one in ten has no calls."""
    kind = F.col("region_ordinal") % 10
    r = V.regions(spark, sf_dir).withColumns({
        "contig": F.when(kind == 9, "ATLANTIS").when(kind == 8, "ASIA").otherwise(F.col("contig")),
        "start": F.when(kind == 8, 900_001).otherwise(F.col("start")),
        "stop": F.when(kind == 8, 900_050).otherwise(F.col("stop")),
    })
    write_lines(r.orderBy("region_ordinal").select(F.concat_ws("\t", "id", "contig", "start", "stop", F.lit("more"))), path, [])


@query(
    f"""WITH {OBSERVED} {WIDE_REGIONS}, inside AS (
  SELECT id, condition, v, w FROM obs s JOIN regions r ON s.contig = r.contig AND position BETWEEN start AND stop
), {moments_sql("inside", "id")}, {TEST_SQL}
SELECT r.id, r.contig, r.start::INT AS start, r.stop::INT AS stop, {PRINTED}, round(CASE WHEN NOT isnan(p) THEN p END, 6) AS p_value,
row_number() OVER (ORDER BY r_regionkey, r.start, r.s_suppkey) - 1 AS place
FROM regions r JOIN region ON r_name = r.contig LEFT JOIN tested t ON t.id = r.id"""
)
def cli_diff_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six call files tested by region: regions in genome order, those on unknown contigs left out, NA without calls."""
    folder = new_path(spark, "regions")
    paths = _track_files(spark, sf_dir, folder, False)
    _region_file(spark, sf_dir, f"{folder}/regions.tab")
    _run(spark, "diff", *_inputs(paths), "--output", f"{folder}/out.tab", "--conditions", "1,1,1,0,0,0", "--regions", f"{folder}/regions.tab")
    f = F.col("f")
    body = _body(spark, f"{folder}/out.tab", "Id\t").select(f[0].alias("id"), f[1].alias("contig"), f[2].cast("int").alias("start"), f[3].cast("int").alias("stop"), *_statistics(4), "ordinal")
    return _numbered(body)


# --- sorted files read side by side ------------------------------------------------

#: Bytes of a piece of the genome here, so that there are many pieces.
PIECE = 1 << 16


@query(
    f"""WITH {TRACKS}, u AS (SELECT contig, contig_order, position, strand, methylated, total FROM tracks WHERE k = 0 AND position % 2 = 0
  UNION ALL SELECT contig, contig_order, position, strand, methylated, total FROM tracks WHERE k = 1 AND position % 3 = 0
  UNION ALL SELECT contig, contig_order, position, strand, methylated, total FROM tracks WHERE k > 1
) SELECT contig, position, strand, sum(methylated)::BIGINT AS methylated, sum(total)::BIGINT AS total, row_number() OVER (ORDER BY contig_order, position) - 1 AS place
FROM u GROUP BY contig, contig_order, position, strand"""
)
def merge_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sorted files, two of them with gaps, merged piece by piece; the partitions follow each other in genome order."""
    folder = new_path(spark, "sorted")
    calls = V.tracks(spark, sf_dir).where("(sample_id != 0 or position % 2 = 0) and (sample_id != 1 or position % 3 = 0)")
    paths = {f"track{k}": f"{folder}/track{k}.tab" for k in range(len(V.TRACK_DEPTHS))}
    write_call_files(calls.withColumn("track", F.concat(F.lit("track"), F.col("sample_id").cast("string"))), "track", paths, V.sequence_dictionary(spark, sf_dir))
    merged = S.merge_sites(read_sites(spark, call_files(spark, list(paths.values())), PIECE))
    return consecutive(merged.withColumn("line", F.monotonically_increasing_id()), "line", "place")


@query(
    f"""WITH {OBSERVED} {moments_sql("obs", "contig, position, strand")}, {TEST_SQL}
SELECT contig, position, strand, round(mean_1, 6) AS sample1_mean, round(mean_2, 6) AS sample2_mean, round(t, 6) AS t_statistic, round(p, 6) AS p_value
FROM tested WHERE NOT isnan(p) AND p <= 0.05"""
)
def diff_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sorted files of two conditions tested site by site, without a shuffle."""
    paths = _track_files(spark, sf_dir, new_path(spark, "sorted"), False)
    found = S.differential_over_sites(read_sites(spark, call_files(spark, paths, [1, 1, 1, 0, 0, 0]), PIECE))
    return found.withColumns({c: rounded(c) for c in ("sample1_mean", "sample2_mean", "t_statistic", "p_value")})


@query(
    f"""WITH {TRACKS}, printed AS (SELECT *, format('{{:.4f}}', methylated / total)::DOUBLE AS r FROM tracks WHERE total >= 9)
SELECT contig, position, strand, round(avg(r), 6) AS ratio, round(stddev_samp(r) / sqrt(count(*)), 6) AS standard_deviation FROM printed GROUP BY contig, position, strand"""
)
def popcall_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratios of six sorted files, of which one is too shallow to count."""
    paths = _track_files(spark, sf_dir, new_path(spark, "sorted"), True)
    found = S.population_sites(read_sites(spark, call_files(spark, paths), PIECE), 9)
    return found.withColumns({c: rounded(c) for c in ("ratio", "standard_deviation")})


@query(
    f"""WITH {TRACKS} SELECT contig, position, strand, k::INT AS sample_id, methylated::INT AS methylated, total::INT AS total FROM tracks
WHERE contig IN ('AFRICA', 'ASIA') OR position BETWEEN 101 AND 150 OR position BETWEEN 1001 AND 1010"""
)
def ranges_of_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole contigs, and two short stretches of all others: only their bytes are read."""
    files = call_files(spark, _track_files(spark, sf_dir, new_path(spark, "sorted"), False))
    whole = contig_ranges(files, {"AFRICA", "ASIA"})
    d = V.dictionary(spark, sf_dir).where("contig not in ('AFRICA', 'ASIA')")
    asked = d.select("contig", F.inline(F.array(F.struct(F.lit(101).alias("start"), F.lit(150).alias("stop")), F.struct(F.lit(1001).alias("start"), F.lit(1010).alias("stop")))))
    sites = read_sites(spark, files, PIECE, sorted(whole + region_ranges(spark, files, asked, 100)))
    return S.site_calls(sites).select("contig", "position", "strand", "sample_id", "methylated", "total")


# --- alignments ---------------------------------------------------------------

MIXED = f"""{READS}, fragments AS (
  SELECT r.ordinal AS one,
         CASE WHEN n % 7 IN (5, 6) OR n % 7 = 3 THEN (SELECT max(x.ordinal) FROM reads x WHERE x.ordinal = r.ordinal + 1) END AS two
  FROM reads r
  WHERE n % 7 = 0 OR (n % 7 IN (1, 3, 4) AND ordinal % 2 = 1) OR (n % 7 IN (2, 5, 6) AND ordinal % 2 = 0)
), sides AS (
  SELECT CASE WHEN b.start < a.start THEN b.ordinal ELSE a.ordinal END AS first, CASE WHEN b.start < a.start THEN a.ordinal ELSE b.ordinal END AS second
  FROM fragments JOIN reads a ON a.ordinal = one LEFT JOIN reads b ON b.ordinal = two
)"""
MIXED_COUNTS = f"""{MIXED}, placed AS (
  SELECT f.contig, f.strand, k.call, k.position FROM sides JOIN reads f ON f.ordinal = first JOIN kept k ON k.ordinal = first
  UNION ALL
  SELECT f.contig, f.strand, k.call, k.position FROM sides JOIN reads f ON f.ordinal = first JOIN kept k ON k.ordinal = second
  WHERE k.position >= k.start + greatest(0, f.start + CASE f.shape WHEN 0 THEN 32 WHEN 1 THEN 30 ELSE 35 END - k.start)
), counts AS ({COUNTED} FROM placed GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {MIXED} SELECT first, second FROM sides")
def mate_pairing_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, single reads, unmapped reads and runs of one name, by adjacency."""
    found = X.fragments(V.mixed_reads(spark, sf_dir), 1024)
    return found.select(F.col("first.ordinal").alias("first"), F.col("second.ordinal").alias("second"))


def _sam_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    d = V.sequence_dictionary(spark, sf_dir, ())
    head = ["@HD\tVN:1.0\tSO:unsorted", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in d.contigs]]
    fields = ["qname", "flag", "contig", "start", F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"),
              F.lit("NM:i:0"), F.concat(F.lit("XM:Z:"), "xm"), F.concat(F.lit("XG:Z:"), "xg")]
    write_lines(V.mixed_reads(spark, sf_dir).orderBy("ordinal").select(F.concat_ws("\t", *fields)), path, head)


def _extracted(spark: SparkSession, sf_dir: str) -> str:
    folder = new_path(spark, "extract")
    _sam_file(spark, sf_dir, f"{folder}/in.sam")
    _run(spark, "extract", "--input", f"{folder}/in.sam", "--output", folder, "--contigs", f"{V.CONTROL} elsewhere")
    return folder


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for context, name in CONTEXT_FILES.items():
        one = _numbered(read_calls(spark, f"{folder}/{name}")[0].drop("ratio")).withColumn("context", F.lit(context))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {MIXED_COUNTS} SELECT context, contig, position, strand, methylated::INT AS methylated, total::INT AS total,
row_number() OVER (PARTITION BY context ORDER BY r_regionkey, position, strand) - 1 AS place FROM counts JOIN region ON r_name = contig"""
)
def cli_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SAM file to four call files by context, each in genome order, plus before minus."""
    return _contexts(spark, _extracted(spark, sf_dir))


@query(
    f"""WITH {MIXED_COUNTS}, s AS (SELECT contig, sum(total) / count(*) AS depth, sum(methylated) / sum(total) AS m FROM counts GROUP BY ROLLUP (contig))
SELECT coalesce(contig, 'All') AS contig, round(depth, 6) AS depth, round(m, 6) AS methylation_ratio,
row_number() OVER (ORDER BY r_regionkey NULLS LAST) - 1 AS place FROM s LEFT JOIN region ON r_name = contig"""
)
def cli_extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary file of an extraction."""
    f = F.col("f")
    body = _body(spark, f"{_extracted(spark, sf_dir)}/summary.tab", "Contig\t")
    return _numbered(body.select(f[0].alias("contig"), F.round(f[1].cast("double"), 6).alias("depth"), F.round(f[2].cast("double"), 6).alias("methylation_ratio"), "ordinal"))


@query(
    f"""WITH {READS}, flags AS (
  SELECT *, n % 7 AS kind, ordinal % 2 = 1 AS odd FROM reads
), f AS (
  SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN odd THEN 9 ELSE 5 END WHEN 2 THEN CASE WHEN odd THEN 5 ELSE 9 END
                      WHEN 3 THEN CASE WHEN odd THEN 3 ELSE 5 END ELSE 3 END AS flag FROM flags
) SELECT CASE WHEN kind IN (3, 4) THEN 'four' || (n // 7) ELSE 'read' || n END AS qname, flag::INT AS flag, CASE WHEN flag IN (5) THEN '*' ELSE contig END AS contig,
  start, CASE shape WHEN 0 THEN '32M' WHEN 1 THEN '10M2I20M' ELSE '10M3D22M' END AS cigar, xm, CASE strand WHEN '+' THEN 'CT' ELSE 'GA' END AS xg,
  row_number() OVER (ORDER BY ordinal) - 1 AS place FROM f"""
)
def scan_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SAM file read back."""
    path = new_path(spark, "scan") + ".sam"
    _sam_file(spark, sf_dir, path)
    return _numbered(read_alignments(spark, path)[0])


@cache
def _packed(cigar: str) -> tuple[int, bytes]:
    """The number of operations, and their codes as a record has them."""
    ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)(\D)", cigar)]
    return len(ops), struct.pack(f"<{len(ops)}I", *[n << 4 | o for n, o in ops])


def _bam_record(contigs: list[str], qname: str, flag: int, contig: str, start: int, cigar: str, xm: str, xg: str) -> bytes:
    """A record of the format: fixed fields, name, operations, no bases, and three tags."""
    n, ops = _packed(cigar)
    ref = contigs.index(contig) if contig in contigs else -1
    name = qname.encode() + b"\0"
    raw = struct.pack("<iiBBHHHiiii", ref, start - 1, len(name), 255, 0, n, flag, 0, -1, -1, 0) + name + ops
    raw += b"NMi" + struct.pack("<i", 0) + b"XMZ" + xm.encode() + b"\0XGZ" + xg.encode() + b"\0"
    return struct.pack("<i", len(raw)) + raw


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return BLOCK + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bam_file(spark: SparkSession, sf_dir: str, path: str, block: int = 4000) -> None:
    """The mixed reads as a BAM file of small blocks, each encoded by the task that has its records; blocks of one file after
    another are a file."""
    d = V.sequence_dictionary(spark, sf_dir, ())
    contigs = [c for c, _ in d.contigs]
    head = b"BAM\1" + struct.pack("<ii", 0, len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in d.contigs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, out = bytearray(), []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held += _bam_record(contigs, *row)
                if len(held) >= block:
                    out.append(_block(bytes(held[:block])))  # a record may go on in the next block
                    del held[:block]
            yield pa.RecordBatch.from_arrays([pa.array([*out, _block(bytes(held))], pa.binary())], ["value"])

    reads = V.mixed_reads(spark, sf_dir).orderBy("ordinal").select("qname", "flag", "contig", "start", "cigar", "xm", "xg")
    write_bytes(reads.mapInArrow(encode, "value binary"), path, _block(head))


def scan_stretch(size: int) -> int:
    """Bytes of a stretch of a BAM file of ``size`` bytes: small, so that there are many, but not more the larger the file is,
    since each looks up where its records start and the next one's; of large files as by default."""
    return min(max(1 << 15, size // 256), STRETCH)


@query(ORACLE["scan_alignments"])
def scan_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BAM file read back in many tasks, whose stretches begin anywhere in its blocks."""
    path = new_path(spark, "scan") + ".bam"
    _bam_file(spark, sf_dir, path)
    with Bytes(path) as f:
        stretch = scan_stretch(f.size)
    return open_alignments(spark, path, stretch=stretch).reads.withColumnRenamed("ordinal", "place")


@query(ORACLE["cli_extract"])
def cli_extract_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BAM file to four call files by context."""
    folder = new_path(spark, "extract")
    _bam_file(spark, sf_dir, f"{folder}.bam", 60_000)
    _run(spark, "extract", "--input", f"{folder}.bam", "--output", folder, "--contigs", f"{V.CONTROL} elsewhere")
    return _contexts(spark, folder)


# --- other files --------------------------------------------------------------


@query("SELECT s_suppkey AS line, s_name || ' of ' || s_suppkey AS value FROM supplier")
def scan_gzip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file of gzip members that does not bear the ending .gz."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat_ws(" of ", "s_name", F.col("s_suppkey").cast("string")).alias("value"), "s_suppkey")
    path = new_path(spark, "lines")
    own.orderBy("s_suppkey").select("value").write.option("compression", "gzip").text(f"{path}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = parts.getFileSystem(conf)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    for p in sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
        part = fs.open(jvm.org.apache.hadoop.fs.Path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()
    first = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.min("s_suppkey")).first()[0]
    return _numbered(lines(spark, path), "line").select((F.col("place") + first).alias("line"), "value")


@query(
    """SELECT r_name AS contig, (p_partkey + 1)::INT AS position, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, (p_partkey % 101) / 100 AS ratio_mean,
CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 7) / 8 END AS ratio_variance, (p_partkey % 3 + 1)::INT AS sample_size, (p_partkey % 50)::INT AS total_depth
FROM part JOIN region ON r_regionkey = p_partkey % 5"""
)
def scan_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consensus file read back: its title has no mark, and the variance of one sample is NaN, a null here."""
    d = V.sequence_dictionary(spark, sf_dir)
    key = F.col("p_partkey")
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("contig"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (key % 5).cast("long").alias("k")).join(F.broadcast(names), "k")  # five rows
    text = [F.col("contig"), key + 1, F.when(key % 2 == 0, "+").otherwise("-"), (key % 101) / 100, F.when(key % 3 > 0, (key % 7) / 8).otherwise(float("nan")), key % 3 + 1, key % 50]
    path = new_path(spark, "consensus")
    title = "Contig\tPosition\tStrand\tRatio Mean\tRatio Variance\tSample Size\tTotal Depth"
    write_lines(rows.orderBy("p_partkey").select(F.concat_ws("\t", *[c.cast("string") for c in text])), path, [CONSENSUS_PRAGMA, *[f"#seq\t{c}\t{n}" for c, n in d.contigs], title])
    found, _ = read_consensus(spark, path)
    return found.withColumn("ratio_variance", F.when(~F.isnan("ratio_variance"), F.col("ratio_variance")))


@query(f"WITH {WIDE_REGIONS} SELECT id, contig, start::INT AS start, stop::INT AS stop, (stop - start + 1)::INT AS length, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM regions")
def scan_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region file read back, and the length of each region."""
    path = new_path(spark, "regions")
    _region_file(spark, sf_dir, path)
    return _numbered(read_regions(spark, path).withColumn("length", region_length(F.col("start"), F.col("stop"))), "region_ordinal")


def _described(d: SequenceDictionary, kind: str, spark: SparkSession) -> DataFrame:
    return d.frame(spark).crossJoin(F.broadcast(reference_length(d.frame(spark)))).withColumn("file", F.lit(kind))  # one row


@query(
    """WITH d AS (SELECT r_name AS contig, r_regionkey, (r_regionkey = 1)::INT AS held FROM region), o AS (
  SELECT contig, r_regionkey, false AS is_control, 'calls' AS file, (row_number() OVER (ORDER BY r_regionkey) - 1) AS k FROM d
  UNION ALL SELECT contig, r_regionkey, held = 1, 'alignments', row_number() OVER (ORDER BY held DESC, r_regionkey) - 1 FROM d
) SELECT file, contig, 1000000::INT AS length, k::INT AS contig_order, is_control, (k * 1000000)::BIGINT AS contig_offset, 5000000::BIGINT AS reference_length FROM o"""
)
def header_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionaries in the headers of a call file and of a SAM file, here with a control contig that is moved to the front."""
    folder = new_path(spark, "headers")
    write_calls(V.tracks(spark, sf_dir).where("sample_id = 0"), f"{folder}/calls.tab", V.sequence_dictionary(spark, sf_dir, ()))
    _sam_file(spark, sf_dir, f"{folder}/x.sam")
    second = V.sequence_dictionary(spark, sf_dir).contigs[1][0]
    a, b = read_calls(spark, f"{folder}/calls.tab")[1], read_alignments(spark, f"{folder}/x.sam", (second,))[1]
    return _described(a, "calls", spark).unionByName(_described(b, "alignments", spark))


@query(
    f"""WITH {TRACKS} SELECT k::INT AS sample_id, CASE WHEN k < 2 THEN 1 ELSE 0 END AS condition, contig, position, strand, methylated::INT AS methylated, total::INT AS total,
contig_order * 1000000 + position <= 2500000 AS in_front FROM tracks WHERE k < 4"""
)
def scan_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four call files as one frame: samples, conditions and a place to compare with."""
    paths = _track_files(spark, sf_dir, new_path(spark, "samples"), False, 4)
    calls, d = read_samples(spark, paths, [1, 1, 0, 0])
    own = C.with_contigs(calls, d.frame(spark))
    front = F.col("contig_offset") + F.col("position") <= 2_500_000
    return own.select("sample_id", "condition", "contig", "position", "strand", "methylated", "total", front.alias("in_front"))


# --- functions ----------------------------------------------------------------


@query(
    """WITH c AS (SELECT k, r_regionkey, r_name, greatest(k * 300000, r_regionkey * 1000000) AS low, least((k + 1) * 300000, (r_regionkey + 1) * 1000000) AS high
  FROM range(17) t(k), region)
SELECT k AS chunk, r_name AS contig, (low - r_regionkey * 1000000 + 1)::BIGINT AS start, (high - r_regionkey * 1000000)::BIGINT AS stop FROM c WHERE low < high"""
)
def genome_chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome in chunks that contigs may straddle."""
    return genome_chunks(V.dictionary(spark, sf_dir), 300_000)


@query(
    """SELECT o_orderkey, CASE WHEN p > 0 AND p <= 5000000 THEN r_name WHEN p > 5000000 THEN (SELECT max_by(r_name, r_regionkey) FROM region) END AS contig,
CASE WHEN p > 5000000 THEN 1000000 WHEN p > 0 THEN (p - 1) % 1000000 + 1 END::INT AS position
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey * 997 % 6000000 - 100000 END AS p FROM orders) LEFT JOIN region ON r_regionkey = (p - 1) // 1000000 AND p > 0"""
)
def inverse_coordinates_at_the_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear positions below 1, past the end, and null."""
    key = F.col("o_orderkey")
    at = F.when(key % 10 != 3, key * 997 % 6_000_000 - 100_000)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", at.alias("linear_position"))
    return from_linear(orders, V.dictionary(spark, sf_dir)).drop("linear_position")


@query(
    f"""WITH {TRACKS}, m AS (
  SELECT contig, position, sum(methylated) FILTER (k < 3) / sum(total) FILTER (k < 3) AS a, sum(methylated) FILTER (k >= 3) / sum(total) FILTER (k >= 3) AS b
  FROM tracks GROUP BY contig, position
) SELECT contig, position, a = b OR abs(a - b) <= abs(a) * 0.25 AS near FROM m"""
)
def approximate_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the means of two conditions agree within a quarter."""
    means = D.site_moments(V.tracks(spark, sf_dir).withColumn("condition", (F.col("sample_id") < 3).cast("int")))
    return means.select("contig", "position", close_to(F.col("mean_2"), F.col("mean_1"), 0.25).alias("near"))


@query("SELECT 'a call has no ratio' AS error, count(*) AS depth_below FROM lineitem WHERE l_quantity < 10")
def population_needs_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call without a ratio is an error where it counts, and none below the depth."""
    calls = V.raw_calls(spark, sf_dir).withColumn("ratio", F.when(F.col("total") >= 10, F.lit(0.5)))
    below = calls.where("ratio is null").count()
    C.population_call(calls, 10).write.format("noop").mode("overwrite").save()
    try:
        C.population_call(calls, 9).write.format("noop").mode("overwrite").save()
        found = "none"
    except Exception as e:
        found = "a call has no ratio" if "a call has no ratio" in str(e) else str(e)
    return spark.createDataFrame([(found, below)], "error string, depth_below long")


@query("SELECT s_name AS verb, 0::INT AS code FROM supplier")
def cli_other_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown verb prints the help and ends normally: each supplier's name is one."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for verb in b.column(0).to_pylist():
                with contextlib.redirect_stdout(io.StringIO()) as said, contextlib.redirect_stderr(io.StringIO()):
                    try:
                        out.append(cli.main([verb]))
                    except SystemExit as e:
                        out.append(e.code if "usage" in said.getvalue() else 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], ["verb", "code"])

    verbs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("verb"))
    # one small file, and each row is a call: a number of parts that is not merged for their few bytes
    own = verbs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "verb")
    return own.mapInArrow(codes, "verb string, code int")


@query(
    f"""WITH {TRACKS} SELECT 'track' || k AS file, count(*) AS lines, sum(length(contig || position || strand || methylated || total) + 4)::BIGINT AS characters
FROM tracks WHERE k < 2 GROUP BY k UNION ALL SELECT 'empty', 0, 0"""
)
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sorted pass written as several files, one of them without rows."""
    folder = new_path(spark, "split")
    both = V.tracks(spark, sf_dir).where("sample_id < 2")
    line = F.concat_ws("\t", "contig", "position", "strand", "methylated", "total")
    names = ("track0", "track1", "empty")
    rows = both.orderBy("sample_id", "contig", "position").select(F.concat(F.lit("track"), F.col("sample_id").cast("string")), line)
    write_files(rows, {n: (f"{folder}/{n}", ["#title"]) for n in names})
    out = None
    for n in names:
        body = _body(spark, f"{folder}/{n}").agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.length(F.array_join("f", " "))), F.lit(0)).alias("characters"))
        one = body.withColumn("file", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
