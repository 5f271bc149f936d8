"""Scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path

#: Rows that a Python worker takes from an Arrow batch of whole texts at once; bounds memory only.
TEXT_ROWS = 1000


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and return it read back: lineage is cut, and
    the rows survive the loss of any executor. The table stays until the shared
    folder is cleaned, since results are lazy and may still read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # the table is read only after the write has ended, so it needs no marker of that
    df.write.options(compression="zstd", **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path  # for drop()
    return back


def drop(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``TEXT_ROWS`` rows, so that what is made of one is sent before the next is made."""
    for b in batches:
        for at in range(0, b.num_rows, TEXT_ROWS):
            yield b.slice(at, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column bears it in any case, so that no user column is touched."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def root_bits(rows: int) -> int:
    """Bits of a hash that make about as many blocks as each has rows: sums over rows in a block, and
    over blocks, are then both of the square root of the rows, whatever their number."""
    return max(rows, 1).bit_length() // 2
