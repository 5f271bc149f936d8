"""Text lines by the bytes that a file starts with, and headers on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bgzf import is_blocked, loaded
from .ranges import reachable

#: Fixed value: the first bytes of gzip content.
GZIP = b"\x1f\x8b"


def _opened(spark: SparkSession, path: str):
    """A stream of a file, or of the first part of a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._")
        if not names:
            raise ValueError(f"{path} has no files")
        where = hadoop.Path(where, names[0])
    return fs.open(where)


def first_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes:
    """The first bytes of a file, through the file system that the engine uses for the path."""
    stream = _opened(spark, path)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


#: Bytes that are inflated in a step.
STEP = 1 << 22


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rest, data, z = b"", content.as_py(), zlib.decompressobj(31)
            while data:
                lines = (rest + z.decompress(data, STEP)).split(b"\n")
                rest, data = lines.pop(), z.unconsumed_tail
                if z.eof:  # one gzip member after another
                    data, z = z.unused_data, zlib.decompressobj(31)
                yield _rows(lines)
            lines = (rest + z.flush()).split(b"\n")
            yield _rows(lines if lines[-1] else lines[:-1])


def _rows(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.decode().rstrip("\r") for x in lines], pa.string())], ["value"])


def is_stretched(path: str) -> bool:
    """Whether many tasks can read a gzip file: it is in blocks, and they can open it."""
    return reachable(path) and is_blocked(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of a file, or of the files of a folder, and numbers that grow along them. Gzip
    content is recognised whatever the file is called; block gzip is read by many tasks; other gzip files are in one
    task each, which inflates them step by step."""
    packed = first_bytes(spark, path) == GZIP
    if packed and is_stretched(path):
        text = loaded(spark, "bgzf_lines", path)
    elif packed and not path.endswith(".gz"):
        text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_inflate, "value string")
    else:
        text = spark.read.text(path).select("value")
    return text.withColumn("line", F.monotonically_increasing_id())


def header(spark: SparkSession, path: str, mark: str) -> tuple[list[str], str | None]:
    """The leading lines of a file that start with ``mark``, and the line after them: metadata, read as a
    stream on the driver, so no job runs over the file for it."""
    jvm = spark.sparkContext._jvm
    stream = _opened(spark, path)
    try:
        plain = jvm.java.util.zip.GZIPInputStream(stream) if first_bytes(spark, path) == GZIP else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, jvm.java.nio.charset.StandardCharsets.UTF_8))
        found = []
        while (line := reader.readLine()) is not None and line.startswith(mark):
            found.append(line)
        return found, line
    finally:
        stream.close()


#: Bits of a number from ``monotonically_increasing_id`` that count the rows of a partition.
WITHIN = 33


def consecutive(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df`` with ``name`` instead of ``number``, the place of each row from 0 on in the order of numbers that grow from row
    to row and along the partitions, as a scan gives them. No row is moved or held; one count for each partition is summed
    up on the driver."""
    counts = sorted((r["p"], r["count"]) for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    own = df.drop(number).withColumn("_line", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_line", WITHIN))
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    known = own.join(F.broadcast(starts), "_part")  # 16 bytes for each partition
    return known.withColumn(name, F.col("_before") + F.col("_line").bitwiseAND((1 << WITHIN) - 1)).drop("_part", "_before", "_line")
