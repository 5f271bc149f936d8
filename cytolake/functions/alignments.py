"""Methylation calls of an aligned read: the CIGAR string walked along the call string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONTEXT_LETTERS


def operations(cigar: Column) -> Column:
    """An array of (size, op) structs; anything but M, I and D raises an error."""
    ops = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=*])"), 0),
        lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("int").alias("size"), F.substring(o, -1, 1).alias("op")),
    )
    bad = F.raise_error(F.concat(F.lit("unrecognized operation encountered in "), F.coalesce(cigar, F.lit("null"))))
    return F.when(F.regexp_like(cigar, F.lit(r"^(?:\d+[MID])+$")), ops).otherwise(F.when(F.lit(True), bad).cast("array<struct<size:int,op:string>>"))


def reference_length(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(o["op"] == "I", 0).otherwise(o["size"]))


def blocks(ops: Column, start: Column) -> Column:
    """An array of (first, last, position) structs, one for each M: the calls that it covers, counted
    from 0, and the reference position of the first. I steps along the calls, D along the reference."""
    none = F.array().cast("array<struct<first:int,last:int,position:int>>")
    zero = F.struct(start.cast("int").alias("ref"), F.lit(0).alias("query"), none.alias("out"))

    def step(s: Column, o: Column) -> Column:
        size = o["size"]
        block = F.struct(s["query"].alias("first"), (s["query"] + size - 1).alias("last"), s["ref"].alias("position"))
        return F.struct(
            F.when(o["op"] == "I", s["ref"]).otherwise(s["ref"] + size).cast("int").alias("ref"),
            F.when(o["op"] == "D", s["query"]).otherwise(s["query"] + size).cast("int").alias("query"),
            F.when(o["op"] == "M", F.concat(s["out"], F.array(block))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ops, zero, step)["out"]


def context(call: Column) -> Column:
    """The sequence context of a call letter; other letters raise an error."""
    out = None
    for letter, name in CONTEXT_LETTERS.items():
        out = F.when(F.upper(call) == letter, F.lit(name)) if out is None else out.when(F.upper(call) == letter, F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown methylation call "), call)).cast("string"))


def is_methylated(call: Column) -> Column:
    return (call == F.upper(call)).cast("int")


def strand(xg: Column) -> Column:
    return F.when(xg == "CT", F.lit("+")).otherwise(F.lit("-"))
