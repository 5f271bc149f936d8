"""Sequence dictionaries: contig lengths and order, control contigs, linear coordinates."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SequenceDictionary:
    """Contigs as (name, length) in file order, and the names of control contigs.

    The sorted order has control contigs first and keeps the file order otherwise."""

    contigs: tuple[tuple[str, int], ...]
    controls: tuple[str, ...] = ()

    @cached_property
    def ordered(self) -> tuple[tuple[str, int], ...]:
        held = set(self.controls)
        return tuple(sorted(self.contigs, key=lambda c: c[0] not in held))

    @cached_property
    def offsets(self) -> tuple[int, ...]:
        return tuple(accumulate((n for _, n in self.ordered), initial=0))[:-1]

    @property
    def reference_length(self) -> int:
        return sum(n for _, n in self.contigs)

    def index(self, contig: str) -> int:
        for i, (name, _) in enumerate(self.ordered):
            if name == contig:
                return i
        raise KeyError(f"{contig} is not defined")

    def to_linear(self, contig: str, position: int, offset: int = 0) -> int:
        """A position counted along all contigs, less ``offset``."""
        return self.offsets[self.index(contig)] - offset + position

    def from_linear(self, position: int, offset: int = 0) -> tuple[str, int]:
        """The contig and position of a linear coordinate; past the end, the last position."""
        at = position + offset
        stops = [o + n for o, (_, n) in zip(self.offsets, self.ordered, strict=True)]
        i = bisect_left(stops, at)
        return (self.ordered[-1][0], self.ordered[-1][1]) if i == len(stops) else (self.ordered[i][0], at - self.offsets[i])

    def chunks(self, size: int) -> list[list[tuple[str, int, int]]]:
        """The genome in chunks of ``size`` bases: for each, (contig, first, last position) of its parts."""
        out = []
        for low in range(0, self.reference_length, size):
            high = min(low + size, self.reference_length)
            parts = zip(self.ordered, self.offsets, strict=True)
            out.append([(c, max(low - o, 0) + 1, min(high - o, n)) for (c, n), o in parts if o < high and o + n > low])
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(contig, length, contig_order, is_control, contig_offset)."""
        held = set(self.controls)
        rows = [(c, n, i, c in held, o) for i, ((c, n), o) in enumerate(zip(self.ordered, self.offsets, strict=True))]
        return spark.createDataFrame(rows, "contig string, length int, contig_order int, is_control boolean, contig_offset long")


def with_contigs(df: DataFrame, dictionary: DataFrame, strict: bool = True) -> DataFrame:
    """``df`` with contig_order, is_control and contig_offset. A contig that the dictionary lacks raises
    an error, or, if not ``strict``, its rows are dropped."""
    cols = dictionary.select("contig", "contig_order", "is_control", "contig_offset")
    if not strict:
        return df.join(cols, "contig")
    out = df.join(cols, "contig", "left")
    names = [*df.columns, "contig_order", "is_control", "contig_offset"]

    def checked(name: str) -> Column:
        error = F.raise_error(F.concat(F.coalesce(F.col("contig"), F.lit("null")), F.lit(" is not defined")))
        return F.when(F.col("contig_order").isNotNull(), F.col(name)).otherwise(error.cast(out.schema[name].dataType)).alias(name)

    # in every column that a query may be left with, so that no plan drops such a row before it is seen
    held = {"contig", "contig_order", "is_control", "contig_offset"}
    return out.select(*[checked(n) if n in held else F.col(n) for n in names])


def linear_position(offset: Column, position: Column) -> Column:
    return offset + position


def bin_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def precedes(contig_order: Column, position: Column, stop_order: Column, stop_position: Column) -> Column:
    """Whether a place comes before another or is the same, by contig and then position."""
    return F.struct(contig_order.cast("int"), position.cast("long")) <= F.struct(stop_order.cast("int"), stop_position.cast("long"))
