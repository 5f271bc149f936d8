"""Bismark alignments: SAM text, and BAM."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import SequenceDictionary
from ..operators.extract import pairs_up
from .bgzf import RECORDS, ROWS, STRETCH, Contents, decoded, is_blocked, loaded, read_header, record_batch
from .lines import GZIP, WITHIN, first_bytes, header, is_stretched, lines
from .ranges import Bytes, reachable

_KEPT = [k.split()[0] for k in RECORDS.split(", ")]


@dataclass(frozen=True)
class Alignments:
    """``reads``: (qname, flag, contig, start, cigar, xm, xg, ordinal); ``paired``: whether any can take a mate along."""

    reads: DataFrame
    dictionary: SequenceDictionary
    paired: bool


def _sam_dictionary(head: list[str], controls: tuple[str, ...]) -> SequenceDictionary:
    tags = [dict(f.split(":", 1) for f in x.split("\t")[1:] if ":" in f) for x in head if x.startswith("@SQ\t")]
    return SequenceDictionary(tuple((t["SN"], int(t["LN"])) for t in tags), tuple(controls))


def _first_lines(found: list[tuple[int, int]]) -> dict[int, int]:
    """The number of the first line of each partition, from (partition, lines)."""
    out, before = {}, 0
    for part, n in sorted(found):
        out[part] = before
        before += n
    return out


def _ordinal(rows: DataFrame, first: dict[int, int]) -> DataFrame:
    """``ordinal`` instead of ``line``: numbers that jump between partitions made consecutive. The records are not moved;
    ``first`` has an entry for each partition of the scan."""
    offsets = rows.sparkSession.createDataFrame(list(first.items()), "_part long, _before long")
    own = rows.withColumn("_part", F.shiftright("line", WITHIN)).join(F.broadcast(offsets), "_part")  # 16 bytes for each partition
    return own.withColumn("ordinal", F.col("_before") + F.col("line").bitwiseAND((1 << WITHIN) - 1)).drop("_part", "_before", "line")


def _flag(value: Column) -> Column:
    return F.split(value, "\t", 3)[1].cast("int")


def _open_sam(spark: SparkSession, path: str, controls: tuple[str, ...]) -> Alignments:
    text = lines(spark, path)
    dictionary = _sam_dictionary(header(spark, path, "@")[0], controls)
    is_read = ~F.startswith("value", F.lit("@"))
    # one pass before the work: lines by partition, and whether any read pairs up
    pairs = F.when(is_read, pairs_up(_flag(F.col("value"))))
    seen = text.groupBy(F.shiftright("line", WITHIN).alias("p")).agg(F.count("*").alias("n"), F.max(pairs).alias("pairs")).collect()
    rows = _ordinal(text, _first_lines([(r["p"], r["n"]) for r in seen])).where(is_read)
    f = F.split("value", "\t")
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:Z:([^\t]*)", 1), F.lit(""))
    reads = (
        rows.select(
            f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("contig"), f[3].cast("int").alias("start"),
            f[5].alias("cigar"), tag("XM").alias("xm"), tag("XG").alias("xg"), "ordinal",
        )
    )
    one_task = first_bytes(spark, path) == GZIP and not is_stretched(path)
    return Alignments(_spread(reads) if one_task else reads, dictionary, any(r["pairs"] for r in seen))


def _spread(reads: DataFrame) -> DataFrame:
    """Reads of a file that one task decodes, dealt to all tasks before each becomes many calls: to a number of
    parts that is not merged again for the few bytes that reads have before that."""
    return reads.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ordinal")


# --- BAM --------------------------------------------------------------------


def _inflated(data: bytes) -> Iterator[bytes]:
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data


class _Stream:
    """Bytes of a gzip file, a few members at a time."""

    def __init__(self, data: bytes) -> None:
        self.blocks, self.held, self.at = _inflated(data), b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                return b""
            self.held, self.at = self.held[self.at :] + block, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _bam_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            s, rows = _Stream(content.as_py()), []
            contigs = [c for c, _ in read_header(s)]
            while size := s.take(4):
                rows.append(decoded(s.take(struct.unpack("<i", size)[0]), contigs))
                if len(rows) == ROWS:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows)


def _bam_contigs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            found = read_header(_Stream(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["contig", "length"])


def _open_whole_bam(spark: SparkSession, path: str, controls: tuple[str, ...]) -> Alignments:
    """A BAM file that is not in blocks, or that only the engine can open: one task decodes it, so it must be below 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = [(r["contig"], r["length"]) for r in files.mapInArrow(_bam_contigs, "contig string, length long").collect()]
    records = files.mapInArrow(_bam_records, RECORDS)
    lined = records.withColumn("line", F.monotonically_increasing_id())
    seen = lined.groupBy(F.shiftright("line", WITHIN).alias("p")).agg(F.count("*").alias("n"), F.max(pairs_up(F.col("flag"))).alias("pairs")).collect()
    reads = _ordinal(lined, _first_lines([(r["p"], r["n"]) for r in seen])).select(*_KEPT, "ordinal")
    return Alignments(_spread(reads), SequenceDictionary(tuple(head), tuple(controls)), any(r["pairs"] for r in seen))


def _open_bam(spark: SparkSession, path: str, controls: tuple[str, ...], stretch: int | None) -> Alignments:
    """A BAM file of blocks, a stretch of them a task; by default four for each core, of 1 MB to 32 MB. The pass before the work
    counts records and does not decode them."""
    if stretch is None:
        with Bytes(path) as f:
            stretch = min(STRETCH, max(1 << 20, f.size // (4 * spark.sparkContext.defaultParallelism)))
    how = {"stretch": str(stretch)}
    numbered = loaded(spark, "bam", path, summary="true", **how).select(F.spark_partition_id().alias("p"), "n", "pairs")
    seen = numbered.collect()
    records = loaded(spark, "bam", path, **how).withColumn("line", F.monotonically_increasing_id())
    reads = _ordinal(records, _first_lines([(r["p"], r["n"]) for r in seen])).select(*_KEPT, "ordinal")
    with Bytes(path) as f:
        head = read_header(Contents(f, 0))
    return Alignments(reads, SequenceDictionary(tuple(head), tuple(controls)), any(r["pairs"] for r in seen))


def open_alignments(spark: SparkSession, path: str, controls: tuple[str, ...] = (), stretch: int | None = None) -> Alignments:
    """SAM, compressed or not, or BAM, by the file's ending. ``stretch``: bytes of a BAM file for a task."""
    if path.endswith(".bam") and first_bytes(spark, path) == GZIP:
        if reachable(path) and is_blocked(path):
            return _open_bam(spark, path, controls, stretch)
        return _open_whole_bam(spark, path, controls)
    return _open_sam(spark, path, controls)


def read_alignments(spark: SparkSession, path: str, controls: tuple[str, ...] = ()) -> tuple[DataFrame, SequenceDictionary]:
    """The reads and the dictionary of ``open_alignments``."""
    found = open_alignments(spark, path, controls)
    return found.reads, found.dictionary
