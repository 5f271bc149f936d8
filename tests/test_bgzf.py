"""Block gzip read by many tasks, cut at every place."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cytolake import cli
from cytolake.sources import bgzf as B
from cytolake.sources.alignments import open_alignments, read_alignments
from cytolake.sources.lines import consecutive, header, lines
from cytolake.sources.ranges import Bytes

CONTIGS = [("7", 100_000), ("L", 3_000)]


def block(data, extra=b""):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    more = extra + b"BC" + struct.pack("<HH", 2, 12 + len(extra) + 6 + len(body) + 8 - 1)
    return B.BLOCK + bytes(6) + struct.pack("<H", len(more)) + more + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(data, sizes, end=True):
    """Blocks of the given sizes in turn; empty ones in between, a subfield of another kind before the size, an end block."""
    out, at, k = b"", 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out += block(data[at : at + n], b"XY" + struct.pack("<H", 3) + b"abc" if k % 5 == 0 else b"")
        if k % 11 == 3:
            out += block(b"")
        at, k = at + n, k + 1
    return out + (block(b"") if end else b"")


def record(name, flag, ref, pos, ops, xm, xg, rng):
    bases = sum(n for n, o in ops if o in "MI")
    raw = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 255, 0, len(ops), flag, bases, ref, pos - 1, 0) + name.encode() + b"\0"
    raw += struct.pack(f"<{len(ops)}I", *[n << 4 | "MIDNSHP=X".index(o) for n, o in ops]) + bytes(rng.randrange(256) for _ in range((bases + 1) // 2 + bases))
    raw += b"NMi" + struct.pack("<i", 3) + b"ZBBc" + struct.pack("<i", 2) + b"\1\2"
    raw += (b"XMZ" + xm.encode() + b"\0" if xm else b"") + (b"XGZ" + xg.encode() + b"\0" if xg else b"")
    return struct.pack("<i", len(raw)) + raw


def reads(n, seed=0, long=()):
    """Rows and the bytes of a BAM file that has them."""
    rng = random.Random(seed)
    data = b"BAM\1" + struct.pack("<i", 5) + b"@HD\tx" + struct.pack("<i", len(CONTIGS))
    for c, size in CONTIGS:
        data += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", size)
    rows = []
    for i in range(n):
        size = 3000 if i in long else rng.randint(4, 60)
        ops = [(size // 2, "M"), (2, rng.choice("ID")), (size - size // 2, "M")]
        if i % 13 == 5:
            row = (f"r{i}", 4, "*", 0, "*", None, None)
            data += record(row[0], 4, -1, 0, [], None, None, rng)
        else:
            ref = rng.randrange(2)
            xm = "".join(rng.choice("zZxXhHuU..") for _ in range(sum(k for k, o in ops if o in "MI")))
            row = (f"r{i // 2 if i % 3 else i}", rng.choice([0, 16, 99, 147]), CONTIGS[ref][0], rng.randint(1, 2_900), "".join(f"{k}{o}" for k, o in ops), xm, rng.choice(["CT", "GA"]))
            data += record(row[0], row[1], ref, row[3], ops, row[5], row[6], rng)
        rows.append(row)
    return rows, data


@pytest.mark.parametrize("sizes,long", [([4000], ()), ([300, 17, 1, 900], (40, 41, 200)), ([60_000], ()), ([50], (3,))])
def test_records_cut_anywhere(tmp_path, sizes, long):
    rows, data = reads(400, 1, long)
    path = tmp_path / "x.bam"
    path.write_bytes(packed(data, sizes))
    size = path.stat().st_size
    for stretch in (size, size // 2 + 1, 5_000, 997):
        with Bytes(str(path)) as f:
            got = [B.decoded(r, c) for a in range(0, size, stretch) for r, c in B._records(f, a, min(a + stretch, size))]
        assert got == rows, stretch


def test_each_place_of_a_small_file(tmp_path):
    rows, data = reads(30, 2)
    path = tmp_path / "x.bam"
    path.write_bytes(packed(data, [211]))
    with Bytes(str(path)) as f:
        for cut in range(1, f.size):
            got = [B.decoded(r, c) for a, z in ((0, cut), (cut, f.size)) for r, c in B._records(f, a, z)]
            assert got == rows, cut


def test_wrong_guesses_and_broken_files_are_errors(tmp_path, monkeypatch):
    rows, data = reads(200, 3)
    path = tmp_path / "x.bam"
    path.write_bytes(packed(data, [700]))
    read = lambda: [r for a in range(0, path.stat().st_size, 2_000) for r in B._records(Bytes(str(path)), a, min(a + 2_000, path.stat().st_size))]
    assert len(read()) == 200
    found = B.first_record
    monkeypatch.setattr(B, "first_record", lambda f, at, lengths: (lambda x: x and (x[0], x[1] + 1))(found(f, at, lengths)))
    with pytest.raises(ValueError, match="do not meet"):
        read()
    monkeypatch.undo()
    whole = path.read_bytes()
    path.write_bytes(packed(data[:-7], [700]))
    with pytest.raises(ValueError, match="inside a record|do not meet"):
        read()
    path.write_bytes(whole[:2000] + b"\0\0\0\0" + whole[2004:])
    with pytest.raises(ValueError, match="is broken"):
        read()


def test_a_bam_file_in_many_tasks(spark, tmp_path):
    rows, data = reads(3_000, 4, (100, 101))
    path = tmp_path / "x.bam"
    path.write_bytes(packed(data, [9_000, 300]))
    for stretch in (1 << 25, 20_000):
        found = open_alignments(spark, str(path), ("L",), stretch)
        got = [tuple(r) for r in found.reads.orderBy("ordinal").collect()]
        assert got == [(*r, i) for i, r in enumerate(rows)] and found.paired
        assert found.reads.rdd.getNumPartitions() == -(-path.stat().st_size // stretch)
        assert [c for c, _ in found.dictionary.ordered] == ["L", "7"]
    assert spark.read.format("bam").load(str(path)).where("flag = 4").count() == sum(r[1] == 4 for r in rows)
    none, data = reads(0)
    path.write_bytes(packed(data, [100]))
    found = open_alignments(spark, str(path))
    assert found.reads.collect() == [] and not found.paired


def test_bam_and_sam_give_the_same_files(spark, tmp_path):
    rows, data = reads(1_500, 5)
    (tmp_path / "x.bam").write_bytes(packed(data, [5_000]))
    text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in CONTIGS)
    for q, flag, c, start, cigar, xm, xg in rows:
        text += f"{q}\t{flag}\t{c}\t{start}\t255\t{cigar}\t*\t0\t0\t*\t*" + (f"\tXM:Z:{xm}" if xm else "") + (f"\tXG:Z:{xg}" if xg else "") + "\n"
    (tmp_path / "x.sam").write_text(text)
    (tmp_path / "y.sam").write_bytes(packed(text.encode(), [5_000]))
    for name, source in (("a", "x.bam"), ("b", "x.sam"), ("c", "y.sam")):
        assert cli.main(["extract", "-i", str(tmp_path / source), "-o", str(tmp_path / name), "-c", "L"], spark) == 0
    for file in ("CpG_context.tab", "CHG_context.tab", "CHH_context.tab", "CN_CHN_context.tab", "summary.tab"):
        one = (tmp_path / "a" / file).read_text()
        assert one == (tmp_path / "b" / file).read_text() == (tmp_path / "c" / file).read_text() and len(one.splitlines()) > 2
    assert read_alignments(spark, str(tmp_path / "y.sam"))[0].count() == 1_500


@pytest.mark.parametrize("sizes", [[1], [7, 100, 3], [64_000]])
@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
def test_lines_cut_anywhere(tmp_path, sizes, end):
    rng = random.Random(3)
    rows = ["é" * rng.randint(0, 40) + str(i) * (rng.random() < 0.8) for i in range(120)] + ["last"]
    path = tmp_path / "x"
    path.write_bytes(packed(("\n".join(rows) + end).encode(), sizes))
    want = rows + [""] * (len(end) - 1)
    with Bytes(str(path)) as f:
        for stretch in (f.size, 4_001, 333, 40):
            got = [x for a in range(0, f.size, stretch) for chunk in B._own_lines(f, a, min(a + stretch, f.size)) for x in chunk.decode().split("\n")]
            assert got == want, stretch


def test_text_in_blocks(spark, tmp_path):
    rows = [f"line {i}" for i in range(20_000)]
    path = tmp_path / "x.gz"
    path.write_bytes(packed(("#head\n" + "\n".join(rows) + "\n").encode(), [2_000]))
    assert header(spark, str(path), "#") == (["#head"], "line 0")
    got = B.loaded(spark, "bgzf_lines", str(path), stretch="4000")
    assert got.rdd.getNumPartitions() > 5
    numbered = consecutive(got.withColumn("line", F.monotonically_increasing_id()), "line", "place")
    assert [r["value"] for r in numbered.orderBy("place").collect()] == ["#head", *rows]
    assert [r["value"] for r in lines(spark, str(path)).orderBy("line").collect()] == ["#head", *rows]


def test_stretches_of_a_large_file_are_not_many_more():
    from cytolake.plans.file_queries import scan_stretch

    assert scan_stretch(0) == scan_stretch(8 << 20) == 1 << 15  # as many as can be of a small file
    assert all(-(-n // scan_stretch(n)) <= 257 for n in range(1 << 20, 8 << 30, 99_999_989))
    assert scan_stretch(1 << 40) == B.STRETCH


def test_records_are_decoded_once_for_an_extraction(spark, tmp_path):
    """The search for mates reads them several times."""
    from cytolake.operators import extract as X
    from cytolake.plans import file_queries, verbs

    sf = "/root/testdata/sf0.001"
    file_queries._bam_file(spark, sf, f"file:{tmp_path}/x.bam", 60_000)
    found, real = open_alignments(spark, f"file:{tmp_path}/x.bam"), X.extract
    seen = []
    try:
        X.extract = lambda reads, paired=True: seen.append((reads.storageLevel.useDisk, paired)) or real(reads, paired)
        verbs.extract(spark, f"file:{tmp_path}/x.bam", f"file:{tmp_path}/out")
    finally:
        X.extract = real
    assert found.paired and seen == [(True, True)]


def test_places_need_no_shuffle(spark, tmp_path):
    """Rows are numbered where they are, those of a SAM file too, whose numbers are of one row of partitions."""
    path = tmp_path / "x.sam"
    path.write_text("@SQ\tSN:a\tLN:100\n" + "".join(f"r{i}\t0\ta\t1\t255\t1M\t*\t0\t0\t*\t*\tXM:Z:z\tXG:Z:CT\n" for i in range(5_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        numbered = consecutive(read_alignments(spark, str(path))[0], "ordinal", "place")
        assert [(r["qname"], r["place"]) for r in numbered.orderBy("place").collect()] == [(f"r{i}", i) for i in range(5_000)]
        assert numbered.rdd.getNumPartitions() > 4
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stretches_without_blocks(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"")
    with Bytes(str(path)) as f:
        assert B.first_block(f, 0) == 0 and list(B._own_lines(f, 0, 0)) == []
    path.write_bytes(block(b"a\n" * 30_000))
    with Bytes(str(path)) as f:
        assert [list(B._own_lines(f, a, a + 10)) for a in range(10, f.size, 10)] == [[]] * len(range(10, f.size, 10))
