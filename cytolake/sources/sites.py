"""Sorted call files read side by side: one row for each site, with the calls that all files have there.

Files are in genome order, so a site's calls can be brought together without a shuffle. The genome
is cut at places where about as many bytes of all files lie in between, by the keys of lines that are
looked up at even distances. A task takes one piece of the genome: it finds the piece's first and last byte in
every file by bisection and merges the files' lines as streams. Pieces follow each other, so what is
made of a piece alone is in genome order as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dictionary import SequenceDictionary
from ..schema import CALLS_PRAGMA
from .files import call_dictionary
from .lines import GZIP
from .ranges import Bytes, reachable

SITES = "contig string, position int, calls array<struct<sample_id:int,condition:int,strand:string,methylated:int,total:int,ratio:double>>"
_CALL = pa.struct([("sample_id", pa.int32()), ("condition", pa.int32()), ("strand", pa.string()), ("methylated", pa.int32()), ("total", pa.int32()), ("ratio", pa.float64())])
_NAMES = ["contig", "position", "strand", "methylated", "total", "ratio"]
_KINDS = dict(zip(_NAMES, [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()], strict=True))

#: Bytes of all files in a piece of the genome, about, and of all streams of a task that are held at once.
PIECE, HELD = 128 << 20, 4 << 20
#: Regions beyond this number, or beyond half of the genome, are read by a scan of everything.
MOST_REGIONS = 20_000
#: Bases between two regions that are read as one.
NEAR = 50_000
_SITES, _LAST = 20_000, 1 << 62  # rows of a batch, and a key above all


@dataclass(frozen=True)
class Files:
    """Call files that share a dictionary; ``bodies`` has the first byte after each one's header, and its size."""

    paths: list[str]
    bodies: list[tuple[int, int]]
    dictionary: SequenceDictionary
    conditions: list[int] | None = None


def alignable(spark: SparkSession, paths: list[str]) -> bool:
    """Whether tasks can read all of ``paths`` from any byte on: single files, not compressed, that can be opened."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                fine = reachable(path)
                if fine:
                    with Bytes(path) as f:
                        fine = f.at(0, 2) != GZIP
                found.append(fine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.bool_())], ["fine"])

    return not spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(check, "fine boolean").where("not fine").limit(1).count()


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, path) to (i, body, size, seen): where the body starts, and a digest of the marked lines that name contigs."""
    for b in batches:
        bodies, sizes, seen = [], [], []
        for path in b.column("path").to_pylist():
            with Bytes(path) as f:
                at, marks = 0, []
                while at < f.size and (line := f.line(at)).startswith(b"#"):
                    if not marks or line.startswith((b"#seq\t", b"#control\t")):
                        marks.append(line.rstrip(b"\r"))
                    at = f.line_end(at)
                bodies.append(at)
                sizes.append(f.size)
                seen.append(hashlib.sha256(b"\n".join(marks)).hexdigest() if marks and marks[0] == CALLS_PRAGMA.encode() else "")
        yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(bodies, pa.int64()), pa.array(sizes, pa.int64()), pa.array(seen)], ["i", "body", "size", "seen"])


def call_files(spark: SparkSession, paths: list[str], conditions: list[int] | None = None) -> Files:
    """The headers of ``paths``, read by tasks; one row for each comes back. Files whose dictionaries differ are refused."""
    if not paths:
        raise ValueError("no input files")
    if conditions is not None and len(conditions) != len(paths):
        raise ValueError("as many conditions as inputs are needed")
    named = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    rows = sorted(named.mapInArrow(_header, "i int, body long, size long, seen string").collect())
    for r in rows:
        if not r["seen"]:
            raise ValueError(f"{paths[r['i']]} does not start with {CALLS_PRAGMA}")
        if r["seen"] != rows[0]["seen"]:
            raise ValueError(f"{paths[r['i']]} has other contigs than {paths[0]}")
    return Files(paths, [(r["body"], r["size"]) for r in rows], call_dictionary(spark, paths[0]), conditions)


# --- places -------------------------------------------------------------------


def _keys(orders: dict[str, int]) -> Callable[[bytes], int | None]:
    """The key of a line: its contig's place in the dictionary and its position. Marked lines have none."""

    def key(line: bytes) -> int | None:
        if line.startswith(b"#"):
            return None
        contig, position, _ = line.split(b"\t", 2)
        if (order := orders.get(contig.decode())) is None:
            raise ValueError(f"{contig.decode()} is not defined")
        return order << 32 | int(position)

    return key


def _orders(d: SequenceDictionary) -> dict[str, int]:
    return {c: i for i, (c, _) in enumerate(d.ordered)}


def _places(orders: dict[str, int]):
    """(path, body, at, bytes) to (key, bytes): the key of the first line from byte ``at`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _keys(orders)
        for b in batches:
            keys, sizes = [], []
            for path, body, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "body", "at", "bytes")), strict=True):
                with Bytes(path) as f:
                    _, k = f.keyed(key, f.line_from(at, body), f.size)
                    if k is not None:
                        keys.append(k)
                        sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["key", "bytes"])

    return run


def pieces(spark: SparkSession, files: Files, piece: int = PIECE) -> list[int]:
    """Keys that cut the genome, each piece with about ``piece`` bytes of all files. Lines are looked up four times in a
    piece's bytes, and four times in each file at least; the keys found come to the driver, 16 bytes for 32 MB or more."""
    total = sum(size - body for body, size in files.bodies)
    if total <= piece:
        return []
    asked = []
    for path, (body, size) in zip(files.paths, files.bodies, strict=True):
        n = max(4, 4 * (size - body) // piece)
        step = max((size - body) // n, 1)
        asked += [(path, body, body + k * step, step) for k in range(1, n)]
    looked = spark.createDataFrame(asked, "path string, body long, at long, bytes long")
    found = sorted((r["key"], r["bytes"]) for r in looked.mapInArrow(_places(_orders(files.dictionary)), "key long, bytes long").collect())
    out, held = [], 0
    for k, n in found:
        held += n
        if held >= piece and (not out or k > out[-1]):
            out.append(k)
            held = 0
    return out


# --- streams ------------------------------------------------------------------


def _parsed(text: bytes) -> pa.Table:
    """Lines of five or six fields; marked ones are left out."""
    if text.startswith(b"#") or b"\n#" in text:
        text = b"\n".join(x for x in text.split(b"\n") if not x.startswith(b"#"))
    if not text.strip():
        return pa.table({n: pa.array([], k) for n, k in _KINDS.items()})
    first, n = text[: text.find(b"\n") + 1 or None].count(b"\t"), text.count(b"\n") + (not text.endswith(b"\n"))
    if first in (4, 5) and text.count(b"\t") == first * n:
        try:
            made = pacsv.read_csv(
                pa.BufferReader(text),
                pacsv.ReadOptions(use_threads=False, column_names=_NAMES[: first + 1]),
                pacsv.ParseOptions(delimiter="\t", quote_char=False),
                pacsv.ConvertOptions(column_types=_KINDS, null_values=[""]),
            )
            return made if first == 5 else made.append_column("ratio", pa.nulls(made.num_rows, pa.float64()))
        except pa.ArrowInvalid:  # as many fields on average, but not in each line
            pass
    rows = [x.rstrip("\r").split("\t") for x in text.decode().split("\n") if x]
    columns = [[r[i] for r in rows] for i in range(5)]
    made = [columns[0], list(map(int, columns[1])), columns[2], list(map(int, columns[3])), list(map(int, columns[4])), [float(r[5]) if len(r) > 5 and r[5] else None for r in rows]]
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(_KINDS.items(), made, strict=True)})


def _ends(f: Bytes, body: int, low: int, high: int, orders: dict[str, int]) -> tuple[int, int]:
    """The bytes from which on keys are ``low`` and ``high`` or more, from byte ``body`` on. Both are looked for from there, so
    that pieces which meet at a key meet at a byte, in files out of order too, and no line is between them unread."""
    key = _keys(orders)
    start, stop = f.bisect(key, body, low) if low else body, f.bisect(key, body, high) if high < _LAST else f.size
    if start > stop:
        raise _disordered(f)
    return start, stop


def _disordered(f: Bytes) -> ValueError:
    return ValueError(f"{f.path} is not in the order of its contigs and positions; read it as unsorted")


def _stream(f: Bytes, start: int, stop: int, low: int, high: int, orders: dict[str, int], step: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(keys, calls) of the lines of a file from byte ``start`` to ``stop``, whose keys are from ``low`` to below ``high``;
    lines out of order are an error."""
    last = low
    for text in f.lines(start, stop, step):
        t = _parsed(text)
        if not t.num_rows:
            continue
        contig = t["contig"].combine_chunks().dictionary_encode()
        names = contig.dictionary.to_pylist()
        for name in names:
            if name not in orders:
                raise ValueError(f"{name} is not defined")
        order = np.array([orders[n] for n in names], dtype=np.int64)[contig.indices.to_numpy(zero_copy_only=False)]
        keys = order << 32 | t["position"].to_numpy().astype(np.int64)
        if keys[0] < last or keys[-1] >= high or (keys[1:] < keys[:-1]).any():
            raise _disordered(f)
        last = keys[-1]
        yield keys, t


def _together(streams: list[Iterator[tuple[np.ndarray, pa.Table]]]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(keys, samples, calls) in the order of keys and then of samples. What is given out ends before a key that a stream
    may go on with."""
    held: list[tuple[np.ndarray, pa.Table] | None] = [None] * len(streams)
    more = [True] * len(streams)

    def fill(i: int) -> None:
        got = next(streams[i], None)
        if got is None:
            more[i] = False
        elif held[i] is None:
            held[i] = got
        else:
            held[i] = (np.r_[held[i][0], got[0]], pa.concat_tables([held[i][1], got[1]]))

    while True:
        for i in range(len(streams)):
            if held[i] is None and more[i]:
                fill(i)
        if all(h is None for h in held):
            return
        open_ = [held[i][0][-1] for i in range(len(streams)) if more[i] and held[i] is not None]
        edge = min(open_, default=None)
        keys, samples, tables = [], [], []
        for i, h in enumerate(held):
            if h is None:
                continue
            n = len(h[0]) if edge is None else int(np.searchsorted(h[0], edge))
            if n:
                keys.append(h[0][:n])
                samples.append(np.full(n, i, dtype=np.int32))
                tables.append(h[1].slice(0, n))
                held[i] = (h[0][n:], h[1].slice(n)) if n < len(h[0]) else None
        if not keys:  # a stream holds nothing but the edge, and may go on with it
            for i in range(len(streams)):
                if more[i] and held[i] is not None and held[i][0][-1] == edge:
                    fill(i)
            continue
        k, s, t = np.concatenate(keys), np.concatenate(samples), pa.concat_tables(tables)
        by = np.argsort(k, kind="stable")
        yield k[by], s[by], t.take(by)


def _rows(keys: np.ndarray, samples: np.ndarray, t: pa.Table, conditions: list[int] | None) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    condition = pa.array(np.array(conditions, dtype=np.int32)[samples]) if conditions is not None else pa.nulls(len(samples), pa.int32())
    one = lambda c: t[c].combine_chunks()
    calls = pa.StructArray.from_arrays([pa.array(samples), condition, one("strand"), one("methylated"), one("total"), one("ratio")], fields=list(_CALL))
    grouped = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(keys)].astype(np.int32)), calls)
    contig, position = t["contig"].take(pa.array(starts)), t["position"].take(pa.array(starts))
    made = pa.table({"contig": contig, "position": position, "calls": grouped})
    for b in made.to_batches(_SITES):
        yield b


def _read(files: Files, tasks: list[list[tuple[int, int]]]):
    """The numbers of tasks to the sites of their ranges of keys."""
    orders, n = _orders(files.dictionary), len(files.paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, kept = max(HELD // n, 1 << 16), max(1024 // n, 4)
        for b in batches:
            for i in b.column(0).to_pylist():
                with ExitStack() as stack:
                    opened = [stack.enter_context(Bytes(p, kept)) for p in files.paths] if tasks[i] else []
                    places = [body for body, _ in files.bodies]  # ranges ascend, so a search goes on from the last one's end
                    for low, high in tasks[i]:
                        ends = [_ends(f, at, low, high, orders) for f, at in zip(opened, places, strict=True)]
                        places = [stop for _, stop in ends]
                        streams = [_stream(f, *own, low, high, orders, step) for f, own in zip(opened, ends, strict=True)]
                        for keys, samples, t in _together(streams):
                            yield from _rows(keys, samples, t, files.conditions)

    return run


def read_sites(spark: SparkSession, files: Files, piece: int = PIECE, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(contig, position, calls) of sorted files, in genome order along the partitions, without a shuffle; calls of a site are
    in the order of the files, and of lines. ``ranges``: keys from and to which alone is read, in order and apart."""
    ends = [0, *pieces(spark, files, piece), _LAST]
    tasks = [[(a, z)] for a, z in zip(ends, ends[1:], strict=False)]
    if ranges is not None:
        tasks, k = [[] for _ in tasks], 1
        for a, z in ranges:
            while ends[k] <= a:
                k += 1
            for m in range(k, len(ends)):
                if ends[m - 1] < z:
                    tasks[m - 1].append((max(a, ends[m - 1]), min(z, ends[m])))
                else:
                    break
        tasks = [t for t in tasks if t] or [[]]  # where nothing is read, there is no task
    # not spark.range, whose eight bytes a row the planner would take for the size of the sites, and broadcast them in joins
    numbers = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(len(tasks))], len(tasks)), "i long")
    return numbers.mapInArrow(_read(files, tasks), SITES)


def contig_ranges(files: Files, contigs: set[str]) -> list[tuple[int, int]]:
    """The keys of whole contigs, neighbours as one range."""
    out: list[tuple[int, int]] = []
    for i, (c, _) in enumerate(files.dictionary.ordered):
        if c in contigs:
            start = out.pop()[0] if out and out[-1][1] == i << 32 else i << 32
            out.append((start, (i + 1) << 32))
    return out


def region_ranges(spark: SparkSession, files: Files, regions: DataFrame, near: int = NEAR, most: int = MOST_REGIONS) -> list[tuple[int, int]] | None:
    """The keys that ``regions`` (contig, start, stop) cover, those less than ``near`` bases apart as one range; None if there
    are more than ``most`` ranges, or if they cover more than half of the genome: then all is read. Regions on contigs that
    the dictionary lacks cover nothing."""
    w = Window.partitionBy("contig_order", "cell").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = regions.where("start <= stop").join(files.dictionary.frame(spark).select("contig", "contig_order"), "contig").select(
        "contig_order", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")
    )
    # joined inside cells of the genome first, so that no task has all regions of a contig
    cells = known.withColumn("cell", F.floor(F.col("start") / (64 * near)))
    opens = F.coalesce(F.col("start") > F.max("stop").over(w) + near, F.lit(True))
    grouped = cells.withColumn("opens", opens.cast("int")).withColumn("g", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = grouped.groupBy("contig_order", "cell", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("contig_order", "start", "stop").limit(4 * most + 1).collect()
    if len(rows) > 4 * most:
        return None
    out: list[tuple[int, int]] = []
    for order, start, stop in sorted(rows):
        low, high = order << 32 | start, (order << 32 | stop) + 1
        if out and low <= out[-1][1] + near and low >> 32 == out[-1][0] >> 32:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    covered = sum(min(z - a, files.dictionary.ordered[a >> 32][1]) for a, z in out)
    return None if len(out) > most or 2 * covered > files.dictionary.reference_length else out
