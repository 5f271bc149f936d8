import gzip
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytolake import cli
from cytolake.operators.dictionary import SequenceDictionary
from cytolake.sinks import _part_number, write_calls
from cytolake.sources.alignments import read_alignments
from cytolake.sources.files import read_calls, read_consensus, read_regions, read_samples

CALLS = "###methylcf\n#control\tL\n#seq\tL\t100\n#seq\t7\t1000\n#seq\t1\t500\n#Contig\tPosition\tStrand\tMethylated\tTotal\tRatio\n"


def put(path, text, packed=False):
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    return str(path)


@pytest.mark.parametrize("name,packed", [("a.tab", False), ("a.tab.gz", True), ("a.tab", True)])
def test_calls_are_read_whatever_the_compression(spark, tmp_path, name, packed):
    path = put(tmp_path / name, CALLS + "L\t3\t+\t1\t2\n7\t5\t-\t0\t4\t0.25\n7\t6\t-\t0\t0\tNaN", packed)
    df, d = read_calls(spark, path)
    assert [tuple(r)[:5] for r in df.orderBy("ordinal").collect()] == [("L", 3, "+", 1, 2), ("7", 5, "-", 0, 4), ("7", 6, "-", 0, 0)]
    assert [r["ratio"] for r in df.orderBy("ordinal").collect()][:2] == [None, 0.25]
    assert [c for c, _ in d.ordered] == ["L", "7", "1"] and d.controls == ("L",)


def test_marker_is_needed(spark, tmp_path):
    with pytest.raises(ValueError, match="methylcf"):
        read_calls(spark, put(tmp_path / "x", "7\t1\t+\t1\t1\n"))
    with pytest.raises(ValueError):
        read_samples(spark, [])


def test_consensus_skips_its_title(spark, tmp_path):
    path = put(tmp_path / "c", "###cmethylcf\n#seq\t7\t10\nContig\tPosition\tStrand\tMean\tVariance\tSample Size\tDepth\n7\t5\t+\t1.0000\tNaN\t1\t8\n7\t6\t-\t0.5\t0.25\t3\t9\n")
    df, d = read_consensus(spark, path)
    assert [(r["position"], r["ratio_mean"], r["sample_size"]) for r in df.orderBy("position").collect()] == [(5, 1.0, 1), (6, 0.5, 3)] and d.contigs == (("7", 10),)


def test_regions(spark, tmp_path):
    df = read_regions(spark, put(tmp_path / "r", "x\t7\t1\t9\tmore\ny\t1\t2\t3\n"))
    assert [tuple(r)[:4] for r in df.collect()] == [("x", "7", 1, 9), ("y", "1", 2, 3)]
    with pytest.raises(Exception, match="four fields"):
        read_regions(spark, put(tmp_path / "bad", "x\t7\t1\t9\n\n")).collect()


def test_merge_call_and_population_files(spark, tmp_path):
    a = put(tmp_path / "a", CALLS + "L\t3\t+\t1\t20\n7\t5\t-\t2\t4\n1\t9\t+\t3\t3\n")
    out = str(tmp_path / "out")
    assert cli.main(["merge", "-i", a, "-i", a, "-i", a, "-o", out], spark) == 0
    assert open(out).read() == CALLS + "L\t3\t+\t3\t60\n7\t5\t-\t6\t12\n1\t9\t+\t9\t9\n"
    assert cli.main(["call", "-i", a, "-o", out, "-t", "2"], spark) == 0
    assert open(out).read() == CALLS + "7\t5\t-\t2\t4\t0.4737\n1\t9\t+\t3\t3\t1\n"
    b = put(tmp_path / "b", open(out).read().replace("0.4737", "0.2").replace("\t2\t4\t", "\t2\t9\t"))
    assert cli.main(["popCall", "-i", out, "-i", b, "-o", str(tmp_path / "p"), "-c", "2"], spark) == 0
    assert open(tmp_path / "p").read() == "##methylprf\n#seq\tL\t100\n#seq\t7\t1000\n#seq\t1\t500\n#Contig\tPosition\tStrand\tRatio\tStandard Deviation\n7\t5\t-\t0.3368\t0.1368\n1\t9\t+\t1\t0\n"


def test_only_control_calls_leave_a_header(spark, tmp_path):
    a = put(tmp_path / "a", CALLS + "L\t3\t+\t1\t20\n")
    cli.main(["call", "-i", a, "-o", str(tmp_path / "o")], spark)
    assert open(tmp_path / "o").read() == CALLS


def test_diff_files(spark, tmp_path):
    paths = []
    for i, (m, p) in enumerate([(9, 8), (10, 8), (9, 7), (1, 8), (0, 8), (2, 7)]):
        paths.append(put(tmp_path / f"s{i}", CALLS + f"7\t5\t+\t{m}\t10\n1\t3\t-\t{p}\t9\n"))
    inputs = [x for p in paths for x in ("-i", p)]
    assert cli.main(["diff", *inputs, "-o", str(tmp_path / "o"), "-c", "0,0,0,1,1,1"], spark) == 0
    lines = open(tmp_path / "o").read().splitlines()
    assert lines[0] == "Contig\tPosition\tStrand\tSample 1 Mean\tSample 2 Mean\tT Statistic\tP-value"
    assert len(lines) == 2 and lines[1].startswith("7\t5\t+\t0.933\t0.100\t")
    regions = put(tmp_path / "r", "none\t1\t100\t200\nsome\t7\t1\t9\n")
    assert cli.main(["diff", *inputs, "-o", str(tmp_path / "o"), "-c", "0,0,0,1,1,1", "-r", regions], spark) == 0
    lines = open(tmp_path / "o").read().splitlines()
    assert lines[1].startswith("some\t7\t1\t9\t0.933\t0.100\t") and lines[2] == "none\t1\t100\t200\tNA\tNA\tNA\tNA"
    with pytest.raises(ValueError):
        cli.main(["diff", *inputs, "-o", str(tmp_path / "o"), "-c", "0,1"], spark)


SAM = (
    "@HD\tVN:1.0\n@SQ\tSN:7\tLN:1000\n@SQ\tSN:L\tLN:100\n"
    "a\t99\t7\t10\t255\t4M\t=\t12\t0\tACGT\tFFFF\tXM:Z:Z..h\tXG:Z:CT\n"
    "a\t147\t7\t12\t255\t4M\t=\t10\t0\tACGT\tFFFF\tXM:Z:zhXx\tXG:Z:CT\n"
    "b\t4\t*\t0\t0\t*\t*\t0\t0\tA\tF\n"
    "c\t16\tL\t3\t255\t2M\t*\t0\t0\tAC\tFF\tXM:Z:.Z\tXR:Z:CT\tXG:Z:GA\n"
)


def bam(sam):
    contigs = [("7", 1000), ("L", 100)]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, n in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for line in sam.splitlines():
        if line.startswith("@"):
            continue
        f = line.split("\t")
        ops = [] if f[5] == "*" else [int(f[5][:-1]) << 4 | "MIDNSHP=X".index(f[5][-1])]
        ref = -1 if f[2] == "*" else [c for c, _ in contigs].index(f[2])
        raw = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(f[0]) + 1, 255, 0, len(ops), int(f[1]), len(f[9]), -1, -1, 0)
        raw += f[0].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes((len(f[9]) + 1) // 2) + bytes(len(f[9]))
        raw += b"NMi" + struct.pack("<i", 3) + b"ZBBc" + struct.pack("<i", 2) + b"\1\2"
        for tag in f[11:]:
            raw += tag[:2].encode() + b"Z" + tag[5:].encode() + b"\0"
        out += struct.pack("<i", len(raw)) + raw
    z = zlib.compressobj(wbits=31)
    half = len(out) // 2
    return gzip.compress(out[:half]) + z.compress(out[half:]) + z.flush()


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_extract_files(spark, tmp_path, kind):
    path = tmp_path / f"x.{kind}"
    path.write_bytes(SAM.encode() if kind == "sam" else bam(SAM))
    reads, d = read_alignments(spark, str(path), ("L",))
    assert reads.count() == 4 and [c for c, _ in d.ordered] == ["L", "7"]
    assert cli.main(["extract", "-i", str(path), "-o", str(tmp_path), "-c", "L"], spark) == 0
    head = "###methylcf\n#control\tL\n#seq\tL\t100\n#seq\t7\t1000\n#Contig\tPosition\tStrand\tMethylated\tTotal\tRatio\n"
    want = {"CpG": "L\t4\t-\t1\t1\n7\t10\t+\t1\t1\n", "CHG": "7\t14\t+\t1\t1\n7\t15\t+\t0\t1\n", "CHH": "7\t13\t+\t0\t1\n", "CN_CHN": ""}
    for context, rows in want.items():
        assert open(tmp_path / f"{context}_context.tab").read() == head + rows
    summary = open(tmp_path / "summary.tab").read().splitlines()
    assert summary == ["Contig\tDepth\tMethylation Ratio", "L\t1.0\t1.0", "7\t1.0\t0.5", "All\t1.0\t0.6"]


@pytest.mark.parametrize("verb", ["merge", "call", "popCall", "diff", "extract"])
def test_a_contig_that_the_dictionary_lacks_is_an_error(spark, tmp_path, verb):
    out = str(tmp_path / "o")
    if verb == "extract":
        path = put(tmp_path / "x.sam", SAM.replace("c\t16\tL", "c\t16\tGONE"))
        args = ["extract", "-i", path, "-o", str(tmp_path)]
    else:
        path = put(tmp_path / "a", CALLS + "7\t5\t-\t2\t40\t0.5\nGONE\t6\t-\t30\t40\t0.5\n")
        args = [verb, "-i", path, "-o", out] + (["-i", path] if verb in ("merge", "popCall", "diff") else []) + (["-c", "0,1"] if verb == "diff" else [])
    if verb == "diff":
        more = put(tmp_path / "b", CALLS + "7\t5\t-\t2\t40\t0.5\nGONE\t6\t-\t1\t40\t0.5\n")
        args = ["diff", "-i", path, "-i", path, "-i", more, "-i", more, "-o", out, "-c", "0,0,1,1"]
    with pytest.raises(Exception, match="GONE is not defined"):
        cli.main(args, spark)


def test_sinks_refuse_unknown_contigs(spark, tmp_path):
    d = SequenceDictionary((("1", 10),))
    calls = spark.createDataFrame([("2", 1, "+", 1, 1)], "contig string, position int, strand string, methylated int, total int")
    with pytest.raises(Exception, match="2 is not defined"):
        write_calls(calls, str(tmp_path / "o"), d)


def test_parts_are_joined_in_the_order_of_their_numbers():
    names = [f"part-{n:05d}-x" for n in (100_000, 99_999, 7, 1_000_000)]
    assert [_part_number(n) for n in sorted(names, key=_part_number)] == [7, 99_999, 100_000, 1_000_000]


def test_gzip_members_and_a_folder_of_them(spark, tmp_path, monkeypatch):
    from cytolake.sources import lines as L

    text = [f"line {i} é" for i in range(5000)]
    folder = tmp_path / "f"
    folder.mkdir()
    for k in range(2):
        body = "\n".join(text).encode()
        (folder / f"x{k}").write_bytes(gzip.compress(body[:30_001]) + gzip.compress(body[30_001:]))
    one = L.lines(spark, str(folder / "x0")).orderBy("line").collect()
    assert [r["value"] for r in one] == text
    batches = [pa.RecordBatch.from_arrays([pa.array([(folder / "x0").read_bytes()])], ["content"])]
    monkeypatch.setattr(L, "STEP", 100)
    assert [v for b in L._inflate(batches) for v in b.column(0).to_pylist()] == text
    both = spark.read.format("binaryFile").load(str(folder)).select("content").mapInArrow(L._inflate, "value string").withColumn("line", F.monotonically_increasing_id())
    assert both.select("line").distinct().count() == both.count() == 10_000


def test_verbs_of_a_table_are_run_by_many_tasks(spark, tmp_path):
    """One small file, and each row is a call of the command line."""
    from cytolake.plans.file_queries import cli_other_verbs

    spark.range(40).selectExpr("concat('verb', id) as s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = cli_other_verbs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((f"verb{i}", 0) for i in range(40))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cli.parser() is cli.parser()


def test_help(capsys):
    assert cli.main([]) == 0
    assert "popCall" in capsys.readouterr().out


@pytest.mark.parametrize("args", [["other"], ["merge"], ["diff", "-i", "x"]])
def test_wrong_arguments_print_help(capsys, args):
    with pytest.raises(SystemExit) as e:
        cli.main(args)
    assert e.value.code == 0 and "usage" in capsys.readouterr().out
