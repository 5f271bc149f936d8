import math

import pytest
from pyspark.sql import functions as F

from cytolake.operators import calls as C
from cytolake.operators.coordinates import from_linear, genome_chunks, reference_length
from cytolake.operators.dictionary import SequenceDictionary

DICT = SequenceDictionary((("b", 100), ("a", 50), ("lambda", 10)), ("lambda",))
KINDS = "contig string, position int, strand string, methylated int, total int, ratio double, sample_id int, ordinal long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], KINDS)


def test_merge_adds_counts_and_keeps_the_first_strand(spark):
    df = frame(spark, [("a", 1, "-", 1, 2, None, 1), ("a", 1, "+", 2, 3, None, 0), ("b", 9, "+", 0, 4, None, 0), ("a", 1, "-", 5, 5, None, 2)])
    got = {tuple(r) for r in C.merge_calls(df).collect()}
    assert got == {("a", 1, "+", 8, 10), ("b", 9, "+", 0, 4)}


def test_merging_three_copies_triples_and_thirds_restore(spark):
    rows = [("a", i, "+" if i % 2 else "-", i % 3, i % 3 + 1, None) for i in range(1, 31)]
    whole = {(c, p, s, m, t) for c, p, s, m, t, _ in rows}
    triple = frame(spark, [(*r, k) for k in range(3) for r in rows])
    assert {tuple(r) for r in C.merge_calls(triple).collect()} == {(c, p, s, 3 * m, 3 * t) for c, p, s, m, t in whole}
    thirds = frame(spark, [(*r, i % 3) for i, r in enumerate(rows)])
    assert {tuple(r) for r in C.merge_calls(thirds).collect()} == whole


def test_counts_beyond_32_bits_do_not_wrap(spark):
    df = frame(spark, [("a", 1, "+", 2**31 - 1, 2**31 - 1, None, k) for k in range(3)])
    assert C.merge_calls(df).first()["total"] == 3 * (2**31 - 1)


def test_order_is_the_dictionarys(spark):
    df = frame(spark, [("a", 2, "+", 1, 1, None, 0), ("b", 7, "-", 1, 1, None, 0), ("lambda", 1, "+", 1, 1, None, 0), ("b", 7, "+", 1, 1, None, 0), ("a", 1, "+", 1, 1, None, 0)])
    got = [(r["contig"], r["position"], r["strand"]) for r in C.ordered(df, DICT.frame(spark)).collect()]
    assert got == [("lambda", 1, "+"), ("b", 7, "+"), ("b", 7, "-"), ("a", 1, "+"), ("a", 2, "+")]


def test_unknown_contig_raises(spark):
    df = frame(spark, [("x", 2, "+", 1, 1, None, 0)])
    with pytest.raises(Exception, match="x is not defined"):
        C.ordered(df, DICT.frame(spark)).collect()


def test_consensus_corrects_by_the_controls_and_drops_them(spark):
    df = frame(spark, [("lambda", 1, "+", 1, 10, None, 0), ("lambda", 2, "-", 0, 10, None, 0), ("a", 1, "+", 1, 1, None, 0), ("a", 2, "+", 0, 3, None, 0), ("b", 3, "+", 1, 2, None, 0), ("b", 4, "+", 0, 0, None, 0)])
    got = {r["position"]: r["ratio"] for r in C.consensus_call(df, DICT.frame(spark)).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and math.isclose(got[3], (0.5 - 0.05) / 0.95) and math.isnan(got[4])


@pytest.mark.parametrize("rows", [[], [("lambda", 1, "+", 0, 0, None, 0)]])
def test_error_rate_without_control_reads_is_the_default(spark, rows):
    df = frame(spark, [("a", 1, "+", 1, 2, None, 0), *rows])
    assert C.control_error_rate(df, DICT.frame(spark), 0.25).first()[0] == 0.25
    assert C.control_error_rate(df.limit(0), DICT.frame(spark)).first()[0] == 0.0


def test_population_mean_and_standard_error(spark):
    rows = [("a", 1, "+", 2, 5, 0.4, 0), ("a", 1, "+", 4, 5, 0.8, 1), ("a", 1, "+", 1, 1, 1.0, 2), ("b", 2, "-", 1, 9, 0.1, 0)]
    (r,) = C.population_call(frame(spark, rows)).collect()
    assert (r["contig"], r["position"]) == ("a", 1) and math.isclose(r["ratio"], 0.6) and math.isclose(r["standard_deviation"], 0.2)
    assert C.population_call(frame(spark, rows).where("total > 100")).count() == 0


def test_population_needs_ratios_where_it_is_covered(spark):
    fine = frame(spark, [("a", 1, "+", 2, 4, None, 0), ("a", 1, "+", 2, 6, 0.5, 1), ("a", 1, "+", 2, 6, 0.7, 2)])
    assert C.population_call(fine).count() == 1
    with pytest.raises(Exception, match="no ratio"):
        C.population_call(fine, 4).collect()


def test_dictionary_order_controls_first():
    for controls, want in (((), ["b", "a", "lambda"]), (("lambda",), ["lambda", "b", "a"]), (("a", "lambda"), ["a", "lambda", "b"]), (("none",), ["b", "a", "lambda"])):
        assert [c for c, _ in SequenceDictionary(DICT.contigs, controls).ordered] == want


def test_linear_coordinates_and_back():
    d = DICT
    assert d.to_linear("lambda", 1) == 1 and d.to_linear("b", 1) == 11 and d.to_linear("a", 50) == 160 == d.reference_length
    for contig, position in (("lambda", 10), ("b", 1), ("b", 100), ("a", 1)):
        assert d.from_linear(d.to_linear(contig, position)) == (contig, position)
        assert d.from_linear(d.to_linear(contig, position, 5), 5) == (contig, position)
    assert d.from_linear(1000) == ("a", 50)
    with pytest.raises(KeyError):
        d.index("x")


def test_linear_positions_of_a_frame(spark):
    rows = [(i, p) for i, p in enumerate([1, 10, 11, 110, 111, 160, 161, 9999, 0, None])]
    df = spark.createDataFrame(rows, "id int, linear_position long")
    for size in (7, 1 << 20):
        got = {r["id"]: (r["contig"], r["position"]) for r in from_linear(df, DICT.frame(spark), bin_size=size).collect()}
        assert got == {i: DICT.from_linear(p) if p else (None, None) for i, p in rows}


def test_chunks_cover_the_genome_once():
    parts = [p for chunk in DICT.chunks(48) for p in chunk]
    assert sum(b - a + 1 for _, a, b in parts) == 160
    assert DICT.chunks(48)[0] == [("lambda", 1, 10), ("b", 1, 38)] and len(DICT.chunks(48)) == 4


def test_chunks_as_a_frame(spark):
    for size in (1, 7, 48, 160, 1000):
        got = genome_chunks(DICT.frame(spark), size).orderBy("chunk", "start").collect()
        want = [(k, *p) for k, chunk in enumerate(DICT.chunks(size)) for p in chunk]
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert reference_length(DICT.frame(spark)).first()[0] == DICT.reference_length == 160
    assert reference_length(DICT.frame(spark).limit(0)).first()[0] == 0


def test_union_needs_a_condition_for_each_input(spark):
    one = frame(spark, []).drop("sample_id")
    with pytest.raises(ValueError):
        C.union_samples([one, one], [0])
    both = C.union_samples([one, one], [0, 1])
    assert {"sample_id", "condition"} <= set(both.columns) and both.where(F.lit(True)).count() == 0
