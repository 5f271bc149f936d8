"""Sorted files read side by side, against the plans that shuffle, and outputs that tasks write in place."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from cytolake import cli
from cytolake.operators import calls as C
from cytolake.operators import differential as D
from cytolake.operators import sites as S
from cytolake.sinks import write_bytes, write_calls, write_files, write_lines
from cytolake.sources import ranges as R
from cytolake.sources import sites as T
from cytolake.sources.files import read_calls, read_samples

HEAD = "###methylcf\n#control\tL\n#seq\t7\t4000\n#seq\tL\t900\n#seq\t1\t3000\n#Contig\tPosition\tStrand\tMethylated\tTotal\tRatio\n"
CONTIGS = (("L", 900), ("7", 4000), ("1", 3000))  # controls first


def body(seed, share=0.4, contigs=CONTIGS):
    rng, out = random.Random(seed), []
    for contig, n in contigs:
        for p in range(1, n + 1):
            for _ in range(2 if rng.random() < 0.02 else 1):  # some sites twice
                if rng.random() < share:
                    t = rng.randint(0, 12)
                    m = rng.randint(0, t)
                    ratio = f"\t{m / t:.4f}" if t and rng.random() < 0.7 else ""  # lines of five fields and of six
                    out.append(f"{contig}\t{p}\t{rng.choice('+-')}\t{m}\t{t}{ratio}")
    return out


def files(tmp_path, n=4, head=HEAD, **how):
    paths = []
    for k in range(n):
        text = head + "\n".join(body(k, **how))
        path = tmp_path / f"s{k}.tab"
        path.write_text(text + "\n" * (k % 2))  # with and without an end of the last line
        paths.append(str(path))
    return paths


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in df.collect()), key=str)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange") - text.count("BroadcastExchange")


@pytest.mark.parametrize("piece,held", [(1 << 30, 1 << 25), (20_000, 1 << 25), (3_000, 100)])
def test_as_the_plans_that_shuffle(spark, tmp_path, monkeypatch, piece, held):
    monkeypatch.setattr(T, "HELD", held)
    paths, conditions = files(tmp_path), [1, 1, 0, 0]
    own = T.call_files(spark, paths, conditions)
    sites = T.read_sites(spark, own, piece)
    assert (piece > 1 << 20) == (sites.rdd.getNumPartitions() == 1)
    plain, d = read_samples(spark, paths, conditions)
    assert d == own.dictionary
    merged, want = S.merge_sites(sites), C.merge_calls(plain)
    assert [(r["contig"], r["position"]) for r in merged.collect()] == [(r["contig"], r["position"]) for r in C.ordered(want, d.frame(spark)).collect()]
    assert rounded(merged) == rounded(want)
    assert rounded(S.differential_over_sites(sites, significance=None)) == rounded(D.differential_sites(plain, significance=None))
    fill = plain.withColumn("ratio", F.coalesce("ratio", F.lit(0.5)))
    filled = sites.withColumn("calls", F.transform("calls", lambda c: c.withField("ratio", F.coalesce(c["ratio"], F.lit(0.5)))))
    assert rounded(S.population_sites(filled, 4)) == rounded(C.population_call(fill, 4))
    for df in (merged, S.differential_over_sites(sites), S.population_sites(sites)):
        assert exchanges(df) == 0


def test_small_reads_cut_lines_anywhere(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PROBE", 7)
    (path,) = files(tmp_path, 1, share=0.05)
    with R.Bytes(path) as f:
        key = T._keys({c: i for i, (c, _) in enumerate(CONTIGS)})
        lines = [x for x in open(path).read().split("\n") if x and x[0] != "#"]
        starts, at = [], len(HEAD)
        for x in lines:
            starts.append(at)
            at += len(x) + 1
        for contig, p in [(0, 0), (0, 1), (0, 450), (1, 0), (1, 3999), (2, 1), (2, 3000), (3, 0)]:
            want = next((s for s, x in zip(starts, lines, strict=True) if key(x.encode()) >= contig << 32 | p), f.size)
            assert f.bisect(key, len(HEAD), contig << 32 | p) == want
        assert b"".join(f.lines(len(HEAD), f.size, 11)).decode() == open(path).read()[len(HEAD) :]


def test_what_is_not_sorted_is_refused_and_read_as_unsorted(spark, tmp_path):
    rows = list({tuple(r.split("\t")[:2]): r for r in body(1, 0.1)}.values())
    for k, other in enumerate((rows[::-1], rows[:20] + rows[49:19:-1] + rows[50:], rows[200:] + rows[:200])):
        path = tmp_path / f"u{k}"
        path.write_text(HEAD + "\n".join(other) + "\n")
        for piece in (1 << 20, 2_000):
            with pytest.raises(Exception, match="not in the order"):
                T.read_sites(spark, T.call_files(spark, [str(path)] * 2), piece).collect()
        with pytest.raises(Exception, match="as unsorted"):
            cli.main(["merge", "-i", str(path), "-i", str(path), "-o", str(tmp_path / "o")], spark)
        assert cli.main(["merge", "-i", str(path), "-i", str(path), "-o", str(tmp_path / "o"), "--unsorted"], spark) == 0
        fine = tmp_path / "fine"
        fine.write_text(HEAD + "\n".join(rows))
        assert cli.main(["merge", "-i", str(fine), "-i", str(fine), "-o", str(tmp_path / "p")], spark) == 0
        assert (tmp_path / "o").read_text() == (tmp_path / "p").read_text()


def test_verbs_give_the_same_files_either_way(spark, tmp_path):
    paths = files(tmp_path, 4, share=0.6)
    inputs = [x for p in paths for x in ("-i", p)]
    (tmp_path / "regions").write_text("a\t7\t10\t90\nb\t1\t5\t2999\nc\tX\t1\t9\nd\t7\t60\t3000\ne\tL\t890\t9000\n")
    for verb, args in [
        ("merge", inputs), ("call", inputs[:2]), ("call", [*inputs[2:4], "-e", "0.125"]), ("diff", [*inputs, "-c", "1,1,0,0"]), ("diff", [*inputs, "-c", "1,0,1,0", "-r", str(tmp_path / "regions")]),
    ]:
        for name, more in (("fast", []), ("slow", ["--unsorted"])):
            assert cli.main([verb, *args, *more, "-o", str(tmp_path / name)], spark) == 0
        # the last digits of a p-value, printed in full, depend on the order of sums
        one, two = ([[f"{float(x):.9g}" if "." in x else x for x in r.split("\t")] for r in (tmp_path / n).read_text().splitlines()] for n in ("fast", "slow"))
        assert one == two, verb
        assert len((tmp_path / "fast").read_text().splitlines()) > 3


def test_files_that_differ_are_refused(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text(HEAD + "7\t1\t+\t1\t2\n")
    for other in (HEAD.replace("4000", "4001"), HEAD.replace("#control\tL\n", "")):
        b.write_text(other + "7\t1\t+\t1\t2\n")
        for read in (lambda: T.call_files(spark, [str(a), str(b)]), lambda: read_samples(spark, [str(a), str(b)])):
            with pytest.raises(ValueError, match="other contigs"):
                read()
    b.write_text("7\t1\t+\t1\t2\n")
    with pytest.raises(ValueError, match="methylcf"):
        T.call_files(spark, [str(a), str(b)])
    with pytest.raises(ValueError):
        T.call_files(spark, [])
    with pytest.raises(ValueError):
        T.call_files(spark, [str(a)], [1, 2])


def test_odd_files(spark, tmp_path):
    """No rows, marked lines inside, carriage returns, a site of many calls, a last line without an end."""
    texts = ["", "7\t1\t+\t1\t2\r\n7\t2\t-\t0\t2\t0.0\r\n#note\n1\t5\t+\t3\t3\tNaN", "7\t2\t+\t1\t1\n" * 4000 + "7\t3\t+\t1\t1\n", "L\t9\t+\t0\t4\n7\t2\t-\t2\t2"]
    paths = []
    for k, t in enumerate(texts):
        (tmp_path / f"o{k}").write_bytes((HEAD + t).encode())
        paths.append(str(tmp_path / f"o{k}"))
    own = T.call_files(spark, paths)
    for piece in (1 << 20, 300):
        got = [tuple(r) for r in S.merge_sites(T.read_sites(spark, own, piece)).collect()]
        assert got == [("L", 9, "+", 0, 4), ("7", 1, "+", 1, 2), ("7", 2, "-", 4002, 4004), ("7", 3, "+", 1, 1), ("1", 5, "+", 3, 3)]
    empty = T.call_files(spark, paths[:1])
    assert T.read_sites(spark, empty).collect() == []
    assert not T.alignable(spark, [str(tmp_path)]) and not T.alignable(spark, ["viewfs://store/x"]) and T.alignable(spark, paths)
    packed = tmp_path / "z.tab"
    packed.write_bytes(gzip.compress((HEAD + "7\t1\t+\t1\t2\n").encode()))
    assert not T.alignable(spark, [paths[0], str(packed)])
    assert cli.main(["merge", "-i", str(packed), "-i", paths[1], "-o", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out").read_text().splitlines()[6:] == ["7\t1\t+\t2\t4", "7\t2\t-\t0\t2", "1\t5\t+\t3\t3"]


def test_only_the_bytes_near_regions_are_read(spark, tmp_path, monkeypatch):
    paths = files(tmp_path, 2, share=0.9)
    own = T.call_files(spark, paths)
    asked = spark.createDataFrame([("a", "7", 100, 120), ("b", "7", 110, 140), ("c", "7", 150, 160), ("d", "1", 2990, 9999), ("e", "X", 1, 9), ("f", "7", 9, 3)], "id string, contig string, start int, stop int")
    found = T.region_ranges(spark, own, asked, near=5)
    assert found == [((1 << 32) + 100, (1 << 32) + 141), ((1 << 32) + 150, (1 << 32) + 161), ((2 << 32) + 2990, (2 << 32) + 10000)]
    assert T.region_ranges(spark, own, asked, near=20)[0] == ((1 << 32) + 100, (1 << 32) + 161)
    assert T.region_ranges(spark, own, asked, near=5, most=2) is None
    wide = spark.createDataFrame([("7", 1, 4000), ("1", 1, 3000)], "contig string, start int, stop int")
    assert T.region_ranges(spark, own, wide) is None
    assert T.region_ranges(spark, own, asked.limit(0)) == []
    every = {(r["contig"], r["position"]) for r in T.read_sites(spark, own).collect()}
    for piece in (1 << 20, 5_000):
        part = T.read_sites(spark, own, piece, found)
        got = [(r["contig"], r["position"]) for r in part.collect()]
        assert got == sorted(got, key=lambda r: (r[0] == "1", r[1])) and set(got) == {(c, p) for c, p in every if c == "7" and (100 <= p <= 140 or 150 <= p <= 160) or c == "1" and p >= 2990}
    assert T.read_sites(spark, own, 5_000, found).rdd.getNumPartitions() < T.read_sites(spark, own, 5_000).rdd.getNumPartitions() / 3
    assert T.read_sites(spark, own, ranges=[]).collect() == []
    # bytes that a task takes from the files, apart from the search for places
    taken = []
    lines = R.Bytes.lines
    monkeypatch.setattr(R.Bytes, "lines", lambda self, start, stop, step: taken.append(stop - start) or lines(self, start, stop, step))
    import pyarrow as pa

    list(T._read(own, [found])(iter([pa.RecordBatch.from_arrays([pa.array([0])], ["id"])])))
    assert 0 < sum(taken) < 0.03 * sum(size for _, size in own.bodies)


def test_contig_ranges(spark, tmp_path):
    own = T.call_files(spark, files(tmp_path, 1))
    assert T.contig_ranges(own, {"L", "7"}) == [(0, 2 << 32)] and T.contig_ranges(own, {"L", "1"}) == [(0, 1 << 32), (2 << 32, 3 << 32)]
    got = {r["contig"] for r in T.read_sites(spark, own, 2_000, T.contig_ranges(own, {"L", "1"})).select("contig").distinct().collect()}
    assert got == {"L", "1"}


# --- outputs ------------------------------------------------------------------


def test_lines_are_written_in_place_in_their_order(spark, tmp_path):
    lines = spark.range(0, 30_000, 1, 7).select(F.concat(F.lit("é"), F.col("id").cast("string")))
    target = tmp_path / "deep" / "out.tab"
    for _ in range(2):  # and once more over an existing file
        write_lines(lines, f"file:{target}", ["#head", "é"])
        assert target.read_text().split("\n") == ["#head", "é", *(f"é{i}" for i in range(30_000)), ""]
    assert [r["value"] for r in spark.read.text(str(target)).collect()][:3] == ["#head", "é", "é0"]  # no stale checksum beside it
    assert sorted(p.name for p in target.parent.iterdir()) == ["out.tab"]
    write_lines(lines.limit(0), str(target), ["#head"])
    assert target.read_text() == "#head\n"


def test_folders_of_ordered_parts(spark, tmp_path):
    lines = spark.range(0, 100, 1, 5).select(F.col("id").cast("string"))
    write_lines(lines, str(tmp_path / "f"), ["#head"], folder=True)
    parts = sorted(p for p in (tmp_path / "f").iterdir() if p.name.startswith("part"))
    assert len(parts) == 6 and "".join(p.read_text() for p in parts).split() == ["#head", *map(str, range(100))]
    d = T.call_files(spark, files(tmp_path, 1)).dictionary
    calls = read_calls(spark, str(tmp_path / "s0.tab"))[0]
    rows = calls.select(F.concat_ws("\t", "contig", "position", "strand", "methylated", "total"))
    write_lines(rows, str(tmp_path / "g"), HEAD.splitlines(), folder=True)
    again, dictionary = read_calls(spark, str(tmp_path / "g"))
    assert dictionary == d and again.count() == calls.count()


def test_bytes_are_written_in_place(spark, tmp_path):
    rows = spark.range(0, 5_000, 1, 9).select(F.concat(F.lit(b"\0\xff"), F.col("id").cast("string").cast("binary")))
    write_bytes(rows, f"file:{tmp_path}/x", b"head")
    assert (tmp_path / "x").read_bytes() == b"head" + b"".join(b"\0\xff%d" % i for i in range(5_000))
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_several_files_keep_the_order_of_each(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 6).select((F.col("id") % 3).cast("string").alias("k"), F.col("id")).orderBy("k", "id").select("k", F.col("id").cast("string"))
    write_files(rows, {k: (str(tmp_path / k), ["#"]) for k in ("0", "1", "2", "none")})
    for k in range(3):
        assert (tmp_path / str(k)).read_text().split() == ["#", *map(str, range(k, 20_000, 3))]
    assert (tmp_path / "none").read_text() == "#\n"


def test_sorted_rows_are_written_as_they_come(spark, tmp_path):
    own = T.call_files(spark, files(tmp_path, 3))
    merged = S.merge_sites(T.read_sites(spark, own, 4_000))
    write_calls(merged, str(tmp_path / "a"), own.dictionary, sorted_=True)
    write_calls(merged, str(tmp_path / "b"), own.dictionary)
    assert (tmp_path / "a").read_text() == (tmp_path / "b").read_text()


# --- many files in any order ---------------------------------------------------


def test_hundreds_of_files_are_one_scan(spark, tmp_path):
    paths = []
    for k in range(300):
        path = tmp_path / f"s {k}+é%20.tab"  # a name that a path has in another form
        path.write_text(HEAD + f"L\t{k + 1}\t-\t0\t1\n7\t{k % 7 + 1}\t+\t1\t2\n")
        paths.append(str(path))
    packed = tmp_path / "z.tab"
    packed.write_bytes(gzip.compress((HEAD + "7\t1\t+\t1\t2\n").encode()))
    mixed = [*paths, str(packed), paths[0]]  # compressed, and one that is given twice
    conditions = [k % 3 for k in range(302)]
    calls, d = read_samples(spark, mixed, conditions)
    assert [c for c, _ in d.ordered] == ["L", "7", "1"]
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 5
    rows = calls.collect()
    assert len(rows) == 2 * 301 + 1 and all(r["condition"] == r["sample_id"] % 3 for r in rows)
    got = {(r["sample_id"], r["contig"], r["position"]) for r in rows}
    want = {(k, "7", k % 7 + 1) for k in range(300)} | {(k, "L", k + 1) for k in range(300)} | {(300, "7", 1), (301, "7", 1), (301, "L", 1)}
    assert got == want
    (tmp_path / "other.tab").write_text(HEAD.replace("4000", "4001"))
    with pytest.raises(ValueError, match="other.tab has other contigs"):
        read_samples(spark, [*mixed, str(tmp_path / "other.tab")])
    sites = T.read_sites(spark, T.call_files(spark, paths))
    assert {(r["position"], r["total"]) for r in S.merge_sites(sites).where("contig = '7'").collect()} == {(p, 2 * sum(k % 7 + 1 == p for k in range(300))) for p in range(1, 8)}


def test_a_task_holds_little_of_its_piece(tmp_path, monkeypatch):
    """Of a piece of 12 MB, which is less than a task's share, a few MB are parsed at a time."""
    import pyarrow as pa

    from cytolake.operators.dictionary import SequenceDictionary
    from cytolake.sources import sites

    path, n = tmp_path / "x.tab", 600_000
    path.write_text("".join(f"contig_a\t{i}\t+\t1\t20\n" for i in range(1, n + 1)))
    files = sites.Files([str(path)], [(0, path.stat().st_size)], SequenceDictionary((("contig_a", n),), ()))
    sizes, real = [], sites._parsed
    monkeypatch.setattr(sites, "_parsed", lambda text: sizes.append(len(text)) or real(text))
    batches = sites._read(files, [[(0, sites._LAST)]])(iter([pa.record_batch([pa.array([0])], ["id"])]))
    assert sum(b.num_rows for b in batches) == n
    assert sum(sizes) == path.stat().st_size > 10 << 20 and max(sizes) < 5 << 20


def test_the_planner_does_not_broadcast_the_calls_of_sorted_files(spark, tmp_path):
    paths = files(tmp_path)
    own = T.call_files(spark, paths, [1, 1, 0, 0])
    sites = T.read_sites(spark, own, 20_000)
    assert sites._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= sum(size - body for body, size in own.bodies)
    rows = [("7", 40 * k + 1, 40 * k + 60, k) for k in range(100)]
    regions = spark.createDataFrame(rows, "contig string, start int, stop int, region_ordinal long")
    found = D.region_calls(S.site_calls(sites), regions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan
    plain, _ = read_samples(spark, paths, [1, 1, 0, 0])
    columns = ["region_ordinal", "position", "sample_id", "methylated", "total"]
    assert rounded(found.select(columns)) == rounded(D.region_calls(plain, regions).select(columns))
