"""Ordered text outputs.

Rows are formatted and sorted in the cluster and written as part files, whose sizes are then known. Where the
target is a file that any machine can open at any byte (``file:``, also of a shared disk), tasks copy the
parts to their places in it, all at once; elsewhere the output is a folder, and the parts are moved
into it under names in their order. The driver writes headers and moves names, and no line of a body passes it.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import SequenceDictionary, with_contigs
from ..schema import (
    CALLS_HEADER,
    CALLS_PRAGMA,
    CONTEXT_FILES,
    POPULATION_HEADER,
    POPULATION_PRAGMA,
    REGION_HEADER,
    SITE_HEADER,
    SUMMARY_HEADER,
)


def _line(*columns: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])


def _number(column: str) -> Column:
    """At most four decimals, half to even, no trailing zeros."""
    return F.call_function("format_number", F.col(column), F.lit("#.####"))


def _part_number(name: str) -> int:
    return int(name.split("-")[1])


def _local(path: str) -> str:
    """The path on the machine of a ``file:`` path."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, target, at) to the bytes copied: parts into their targets from byte ``at`` on. Copying twice changes nothing."""
    for b in batches:
        done = []
        for part, target, at in zip(*(b.column(c).to_pylist() for c in ("part", "target", "at")), strict=True):
            with open(_local(part), "rb") as source, open(_local(target), "r+b") as out:
                out.seek(at)
                shutil.copyfileobj(source, out, 1 << 22)
                done.append(out.tell() - at)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["n"])


def write_files(df: DataFrame, targets: dict[str, tuple[str, list[str]]], folders: bool | None = None) -> None:
    """Several files from one pass: ``df`` has the key of a file and a line, sorted by key first; ``targets`` has the path and
    the header of each key. Existing files are replaced; headers are written even without rows. ``folders``: whether each
    output is a folder of ordered parts, the header the first; by default, only where files have no places to write to."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    first = next(iter(targets.values()))[0]
    fs = hadoop(first).getFileSystem(conf)
    folders = fs.getScheme() != "file" if folders is None else folders
    parts = hadoop(f"{first}.parts-{uuid.uuid4().hex}")
    rows = df.toDF("file", "line")
    try:
        if len(targets) == 1:
            rows.select("line").write.text(hadoop(parts, f"file={next(iter(targets))}").toString())
        else:
            rows.write.partitionBy("file").text(parts.toString())
        copies, left = [], 0
        for name, (path, header) in targets.items():
            folder = hadoop(parts, f"file={name}")
            held = [s for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName().startswith("part-")]
            held.sort(key=lambda s: _part_number(s.getPath().getName()))
            head = "".join(h + "\n" for h in header).encode()
            fs.delete(hadoop(path), True)
            if folders:
                out = fs.create(hadoop(path, "part-0000000-header"), True)
                out.write(bytearray(head))
                out.close()
                for k, s in enumerate(held, 1):
                    fs.rename(s.getPath(), hadoop(path, f"part-{k:07d}"))
                continue
            at = len(head)
            os.makedirs(os.path.dirname(_local(path)) or ".", exist_ok=True)
            with open(_local(path), "wb") as out:
                out.write(head)
            for s in held:
                copies.append((s.getPath().toUri().getPath(), path, at))
                at += s.getLen()
                left += s.getLen()
        _copied(spark, copies, left)
    finally:
        fs.delete(parts, True)


def _copied(spark: SparkSession, copies: list[tuple[str, str, int]], size: int) -> None:
    """Parts copied to their places by as many tasks as there are cores, or 64 MB each."""
    if copies:
        n = min(len(copies), max(spark.sparkContext.defaultParallelism, -(-size // (64 << 20))))
        placed = spark.createDataFrame(copies, "part string, target string, at long").repartition(n)
        done = placed.mapInArrow(_place, "n long").groupBy().sum().first()[0]
        if done != size:
            raise OSError(f"{done} of {size} bytes were written")


def write_bytes(df: DataFrame, path: str, head: bytes) -> None:
    """``head`` and then the one binary column of ``df``, in the order of ``df``, as one file, which tasks must be able to open.
    Each task writes a part under its own name first, so that a task that runs twice does no harm."""
    spark, folder = df.sparkSession, f"{_local(path)}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            for b in batches:
                for x in b.column(0):
                    out.write(x.as_py())
            size = out.tell()
        os.replace(own, f"{folder}/part-{part:07d}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int64())], ["part", "n"])

    try:
        sizes = sorted((r["part"], r["n"]) for r in df.mapInArrow(keep, "part int, n long").collect())
        with open(_local(path), "wb") as out:
            out.write(head)
        copies, at = [], len(head)
        for part, n in sizes:
            copies.append((f"{folder}/part-{part:07d}", path, at))
            at += n
        _copied(spark, copies, at - len(head))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_lines(df: DataFrame, path: str, header: list[str], folder: bool | None = None) -> None:
    """The header and then the one string column of ``df``, in the order of ``df``, as one output."""
    write_files(df.toDF("line").select(F.lit("all"), "line"), {"all": (path, header)}, folder)


def _sequences(dictionary: SequenceDictionary) -> list[str]:
    return [f"#seq\t{c}\t{n}" for c, n in dictionary.ordered]


def _ordered(df: DataFrame, dictionary: SequenceDictionary, *then: Column | str, first: tuple[str, ...] = (), sorted_: bool = False) -> DataFrame:
    """Rows in genome order, ``first`` before that; a contig that the dictionary lacks raises an error. ``sorted_``: they
    are so already, and their contigs are known."""
    return df if sorted_ else with_contigs(df, dictionary.frame(df.sparkSession)).orderBy(*first, "contig_order", *then)


def _calls_header(dictionary: SequenceDictionary) -> list[str]:
    return [CALLS_PRAGMA, *[f"#control\t{c}" for c, _ in dictionary.ordered if c in set(dictionary.controls)], *_sequences(dictionary), CALLS_HEADER]


def _call_line(calls: DataFrame) -> Column:
    c = F.col
    five = _line(c("contig"), c("position"), c("strand"), c("methylated"), c("total"))
    line = five
    if "ratio" in calls.columns:
        line = F.when(c("ratio").isNull(), five).otherwise(F.concat_ws("\t", five, _number("ratio")))
    return line


def _minus() -> Column:
    return F.when(F.col("strand") == "-", 1).otherwise(0)


def write_calls(calls: DataFrame, path: str, dictionary: SequenceDictionary, sorted_: bool = False) -> None:
    """A call file: six columns where a row has a ratio, five where it has none. ``sorted_``: ``calls`` are in genome order."""
    write_lines(_ordered(calls, dictionary, "position", _minus(), sorted_=sorted_).select(_call_line(calls)), path, _calls_header(dictionary))


def write_population(calls: DataFrame, path: str, dictionary: SequenceDictionary, sorted_: bool = False) -> None:
    c = F.col
    line = _line(c("contig"), c("position"), c("strand"), _number("ratio"), _number("standard_deviation"))
    write_lines(_ordered(calls, dictionary, "position", sorted_=sorted_).select(line), path, [POPULATION_PRAGMA, *_sequences(dictionary), POPULATION_HEADER])


def _statistics() -> list[Column]:
    return [*[F.when(F.col(n).isNotNull(), F.format_string("%.3g", n)) for n in ("sample1_mean", "sample2_mean", "t_statistic")], F.col("p_value")]


def write_sites(sites: DataFrame, path: str, dictionary: SequenceDictionary, sorted_: bool = False) -> None:
    c = F.col
    write_lines(_ordered(sites, dictionary, "position", sorted_=sorted_).select(_line(c("contig"), c("position"), c("strand"), *_statistics())), path, [SITE_HEADER])


def write_regions(regions: DataFrame, path: str, dictionary: SequenceDictionary) -> None:
    """Regions with their statistics, or NA where no test was possible."""
    c = F.col
    rows = _ordered(regions, dictionary, "start", "region_ordinal")
    write_lines(rows.select(_line(c("id"), c("contig"), c("start"), c("stop"), *_statistics())), path, [REGION_HEADER])


def write_call_files(calls: DataFrame, key: str, paths: dict[str, str], dictionary: SequenceDictionary) -> None:
    """Several call files from one sort, by the column ``key``; one without rows has a header."""
    rows = _ordered(calls, dictionary, "position", _minus(), first=(key,)).select(key, _call_line(calls).alias("line"))
    head = _calls_header(dictionary)
    write_files(rows, {name: (path, head) for name, path in paths.items()})


def write_contexts(counts: DataFrame, folder: str, dictionary: SequenceDictionary) -> None:
    """Four call files by sequence context."""
    write_call_files(counts, "context", {name: f"{folder}/{file}" for name, file in CONTEXT_FILES.items()}, dictionary)


def write_summary(summary: DataFrame, path: str) -> None:
    """Depth and ratio by contig, in genome order, All last."""
    rows = summary.orderBy(F.col("contig_order").asc_nulls_last())
    write_lines(rows.select(_line(F.col("contig"), F.col("depth"), F.col("methylation_ratio"))), path, [SUMMARY_HEADER])
