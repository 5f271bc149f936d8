"""Linear coordinates turned back into contigs and positions, and the genome in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .differential import region_calls

#: Bases in a bin of the search; contigs are long, so their bins may be.
BIN = 1 << 20


def region_length(start: Column, stop: Column) -> Column:
    """Bases of a region, ends included."""
    return stop - start + 1


def reference_length(dictionary: DataFrame) -> DataFrame:
    """One row: ``reference_length``, the sum of all contigs."""
    return dictionary.agg(F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("reference_length"))


def genome_chunks(dictionary: DataFrame, size: int) -> DataFrame:
    """(chunk, contig, start, stop): the genome cut after every ``size`` bases, a chunk's parts by contig."""
    low, high = F.col("contig_offset"), F.col("contig_offset") + F.col("length")
    cut = dictionary.where("length > 0").select("*", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))).alias("chunk"))
    return cut.select(
        "chunk", "contig", (F.greatest(F.col("chunk") * size, low) - low + 1).cast("long").alias("start"), (F.least((F.col("chunk") + 1) * size, high) - low).cast("long").alias("stop")
    )


def from_linear(df: DataFrame, dictionary: DataFrame, linear_col: str = "linear_position", bin_size: int = BIN) -> DataFrame:
    """``df`` with the ``contig`` and ``position`` that each linear position falls on.

    Contigs are intervals of one long line, so this is the interval join. A position past the end
    is the last position of the last contig; one below 1, and null, has neither."""
    line = F.lit("genome")
    spans = dictionary.where("length > 0").select(
        line.alias("contig"), F.col("contig").alias("_contig"), F.col("contig_offset").alias("_offset"),
        (F.col("contig_offset") + 1).alias("start"), (F.col("contig_offset") + F.col("length")).alias("stop"),
    )
    last = F.broadcast(  # one row
        dictionary.agg(F.max_by("contig", "contig_order").alias("_last"), F.max(F.col("contig_offset") + F.col("length")).alias("_end"), F.max_by("length", "contig_order").alias("_length"))
    )
    known = F.coalesce(F.col(linear_col) >= 1, F.lit(False))
    nowhere = df.where(~known).withColumns({"contig": F.lit(None).cast("string"), "position": F.lit(None).cast("int")})
    placed = df.where(known).join(last, how="cross").withColumns({"contig": line, "position": F.least(F.col(linear_col).cast("long"), F.col("_end"))})
    found = region_calls(placed, spans, bin_size)
    inside = F.col(linear_col) <= F.col("_end")
    out = found.select(
        *[F.col(c) for c in df.columns],
        F.when(inside, F.col("_contig")).otherwise(F.col("_last")).alias("contig"),
        F.when(inside, F.col("position") - F.col("_offset")).otherwise(F.col("_length")).cast("int").alias("position"),
    )
    return out.unionByName(nowhere)
