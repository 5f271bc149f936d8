"""Call, consensus-call and region files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import SequenceDictionary
from ..schema import CALLS_PRAGMA, CONSENSUS_PRAGMA
from .lines import GZIP, first_bytes, header, lines
from .ranges import Bytes, reachable


def _dictionary(head: list[str], pragma: str, path: str) -> SequenceDictionary:
    if not head or head[0] != pragma:
        raise ValueError(f"{path} does not start with {pragma}")
    fields = [x.split("\t") for x in head[1:]]
    return SequenceDictionary(
        tuple((f[1], int(f[2])) for f in fields if f[0] == "#seq"), tuple(f[1] for f in fields if f[0] == "#control")
    )


def call_dictionary(spark: SparkSession, path: str) -> SequenceDictionary:
    """The dictionary in the header of a call file."""
    return _dictionary(header(spark, path, "#")[0], CALLS_PRAGMA, path)


def _field(i: int, kind: str = "string") -> Column:
    return F.split("value", "\t")[i].cast(kind)


def read_calls(spark: SparkSession, path: str) -> tuple[DataFrame, SequenceDictionary]:
    """(contig, position, strand, methylated, total, ratio, ordinal) and the dictionary of one file.

    ``ratio`` is null in rows of five fields. The first line must be the format's marker."""
    return _calls(lines(spark, path), []), call_dictionary(spark, path)


def _calls(text: DataFrame, keep: list[str]) -> DataFrame:
    rows = text.where(~F.startswith("value", F.lit("#")))
    ratio = F.when(F.size(F.split("value", "\t")) > 5, F.try_element_at(F.split("value", "\t"), F.lit(6)).cast("double"))
    return rows.select(
        _field(0).alias("contig"), _field(1, "int").alias("position"), _field(2).alias("strand"),
        _field(3, "int").alias("methylated"), _field(4, "int").alias("total"), ratio.alias("ratio"), F.col("line").alias("ordinal"), *keep,
    )


#: Files from which headers are read by tasks; fewer are opened by the driver.
MANY = 16


def _heads(paths: list[str]):
    """Numbers of paths to (i, kind, head): how a file can be read, "other" if the task cannot open it, and its marked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, heads = [], []
            for i in b.column(0).to_pylist():
                kind, head = "other", []
                if reachable(paths[i]):
                    with Bytes(paths[i]) as f:
                        kind = "plain" if f.at(0, 2) != GZIP else "packed"
                        at = 0
                        while kind == "plain" and at < f.size and (line := f.line(at)).startswith(b"#"):
                            head.append(line.rstrip(b"\r").decode())
                            at = f.line_end(at)
                kinds.append(kind)
                heads.append("\n".join(head))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds), pa.array(heads)], ["i", "kind", "head"])

    return run


def _described(spark: SparkSession, paths: list[str]) -> tuple[list[bool], SequenceDictionary]:
    """Whether each file is plain text, and the dictionary that all share. Of many files tasks read the headers, and the
    driver sees one row for each kind of header; the driver opens those that a task cannot open, and compressed ones."""
    plain, found, left = [False] * len(paths), {}, list(range(len(paths)))
    if len(paths) >= MANY:
        rows = spark.range(0, len(paths), 1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_heads(paths), "i long, kind string, head string")
        for r in rows.where("kind = 'plain'").groupBy("head").agg(F.collect_list("i").alias("of")).collect():
            first = min(r["of"])
            found[first] = _dictionary(r["head"].split("\n"), CALLS_PRAGMA, paths[first])
            for i in r["of"]:
                plain[i] = True
        left = [i for i in left if not plain[i]]
    for i in left:
        plain[i] = first_bytes(spark, paths[i]) != GZIP
        found[i] = call_dictionary(spark, paths[i])
    least = min(found)
    for i, own in sorted(found.items()):
        if own != found[least]:
            raise ValueError(f"{paths[i]} has other contigs than {paths[least]}")
    return plain, found[least]


def _qualified(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths as the engine's scans report them."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    made, known = [], {}
    for p in paths:
        where = hadoop.Path(p)
        scheme = p.split("://")[0] if "://" in p else ""
        fs = known.setdefault(scheme, where.getFileSystem(conf))
        made.append(fs.makeQualified(where).toString())
    return made


def _together(spark: SparkSession, paths: list[str], samples: list[int]) -> DataFrame:
    """(value, line, sample_id) of plain files by one scan, whose plan does not grow with their number. A file that is given
    several times is scanned once, and its lines are rows of each sample."""
    names = spark.createDataFrame(list(zip(_qualified(spark, paths), samples, strict=True)), "_name string, sample_id int")
    of = names.groupBy("_name").agg(F.collect_list("sample_id").alias("_samples"))
    text = spark.read.text(sorted(set(paths))).select("value", F.monotonically_increasing_id().alias("line"), F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/").alias("_name"))
    own = of.withColumn("_name", F.regexp_replace("_name", "^file:/+", "file:/"))
    return text.join(F.broadcast(own), "_name").select("value", "line", F.explode("_samples").alias("sample_id"))  # a row for each input named


def read_samples(spark: SparkSession, paths: list[str], conditions: list[int] | None = None) -> tuple[DataFrame, SequenceDictionary]:
    """Several call files as one frame with ``sample_id`` and, if given, ``condition``, and the dictionary that they share.
    Files whose dictionaries differ are refused. Plain files, however many, are one scan; compressed ones and folders a
    scan each."""
    if not paths:
        raise ValueError("no input files")
    if conditions is not None and len(conditions) != len(paths):
        raise ValueError("as many conditions as inputs are needed")
    plain, dictionary = _described(spark, paths)
    single = [i for i, p in enumerate(plain) if p and not _is_folder(spark, paths[i], len(paths))]
    parts = [lines(spark, paths[i]).withColumn("sample_id", F.lit(i)) for i in range(len(paths)) if i not in set(single)]
    if single:
        parts.append(_together(spark, [paths[i] for i in single], single))
    rows = _calls(reduce(DataFrame.unionByName, parts), ["sample_id"])
    if conditions is not None:
        rows = rows.withColumn("condition", F.get(F.array(*[F.lit(c) for c in conditions]), F.col("sample_id")) if len(conditions) < 200 else _looked_up(conditions))
    return rows, dictionary


def _looked_up(conditions: list[int]) -> Column:
    """The condition of a sample, from a text of as many numbers, which is one literal however many there are."""
    return F.get(F.split(F.lit(",".join(map(str, conditions))), ","), F.col("sample_id")).cast("int")


def _is_folder(spark: SparkSession, path: str, n: int) -> bool:
    """Whether a path is a folder; of many inputs, which tasks have opened as files, none is."""
    if n >= MANY:
        return False
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def read_consensus(spark: SparkSession, path: str) -> tuple[DataFrame, SequenceDictionary]:
    """Consensus calls; the first line after the marked ones is the column header."""
    text = lines(spark, path)
    head, title = header(spark, path, "#")
    dictionary = _dictionary(head, CONSENSUS_PRAGMA, path)
    # the first line of that text: the least number, and later lines of the same text are rows
    at = text.where(F.col("value") == F.lit(title)).agg(F.min("line")).first()[0] if title is not None else None
    body = text.where(~F.startswith("value", F.lit("#")) & (F.col("line") != F.lit(-1 if at is None else at)))
    kinds = (("contig", "string"), ("position", "int"), ("strand", "string"), ("ratio_mean", "double"), ("ratio_variance", "double"), ("sample_size", "int"), ("total_depth", "int"))
    return body.select(*[_field(i, k).alias(n) for i, (n, k) in enumerate(kinds)]), dictionary


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(id, contig, start, stop, region_ordinal); further fields are ignored, and a line of fewer than four raises an error."""
    text = lines(spark, path)
    whole = F.when(F.size(F.split("value", "\t")) >= 4, F.split("value", "\t")).otherwise(
        F.raise_error(F.concat(F.lit("a region needs four fields: "), F.col("value"))).cast("array<string>")
    )
    return text.select(whole.alias("f"), F.col("line").alias("region_ordinal")).select(
        F.col("f")[0].alias("id"), F.col("f")[1].alias("contig"), F.col("f")[2].cast("int").alias("start"), F.col("f")[3].cast("int").alias("stop"), "region_ordinal"
    )
