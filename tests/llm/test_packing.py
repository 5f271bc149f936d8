import json
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cytolake.llm import packing

PATH = P.path("byte_bpe_50k.json")
KINDS = "doc_id long, text string, source string, start string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], KINDS).repartition(3)


def check(pieces, rows, length=1024):
    """Each id once and in order, sequences without gaps, all full but the last."""
    tk = Tokenizer.from_file(PATH)
    want = sorted(((d if d is not None else -1), tuple([*tk.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, _ in rows)
    by_sequence, by_doc = {}, {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        assert r["length"] == len(r["ids"]) // 4 > 0
    if len({d for d, _, _ in rows}) == len(rows):
        got = []
        for (d, n), parts in by_doc.items():
            ids = []
            for start, x in sorted(parts):
                assert start == len(ids)
                ids += x
            assert len(ids) == n
            got.append((d if d is not None else -1, tuple(ids)))
        assert sorted(got) == want
    assert sum(n for x in by_sequence.values() for _, n in x) == sum(len(x) for _, x in want)
    sizes = []
    for k in range(len(by_sequence)):
        at = 0
        for offset, n in sorted(by_sequence[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == length for n in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= length)


def test_pieces_restore_the_documents(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "naïve", "tokens", "of", "Übung", "x"], int(rng.integers(0, 700)))), f"s{i % 4}") for i in range(40)]
    rows += [(100, None, "s0"), (101, "", None), (102, "a <|endoftext|> b", "s1"), (None, "no id", "s2"), (103, "word " * 6000, "s3")]
    pieces = packing.pack(docs(spark, rows), PATH, P.PATTERN).collect()
    check(pieces, rows)
    assert {r["source"] for r in pieces} == {"s0", "s1", "s2", "s3", None}


def test_repeated_rows_and_no_rows(spark):
    rows = [(7, "the same words again", "a")] * 30
    pieces = packing.pack(docs(spark, rows), PATH, P.PATTERN, length=16, window_sequences=2).collect()
    check(pieces, rows, 16)
    assert packing.pack(docs(spark, rows).limit(0), PATH, P.PATTERN).count() == 0


def test_every_window_has_the_sources_shares(spark):
    rows = [(i, "word " * (20 + i % 50), f"s{min(i % 7, 3)}") for i in range(400)]
    pieces = packing.pack(docs(spark, rows), PATH, P.PATTERN, length=64, window_sequences=4).collect()
    total, window = {}, {}
    for r in pieces:
        w = (r["sequence_id"] * 64 + r["offset"]) // 256
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
        window.setdefault(w, {}).setdefault(r["source"], 0)
        window[w][r["source"]] += r["length"]
    n = sum(total.values())
    for got in list(window.values())[:-1]:
        size = sum(got.values())
        assert all(abs(got.get(s, 0) - size * t / n) < 2 for s, t in total.items())


def literal(own, window):
    """A phase of the round-robin, taken literally: (queue, token) in the order of the packed stream. A queue's quantum
    comes on top of the deficit that it carries; it is served the whole tokens of that, and of the part of a token
    that those before it in the round could not use; what is not served is carried to its next window."""
    total, table = sum(own.values()), {}
    for q, (below, lane, at) in packing.lanes(own, window).items():
        table.setdefault((below, lane), []).append((at, q))
    queues = [[(q, i) for _, q in sorted(members) for i in range(own[q])] for _, members in sorted(table.items())]
    share = [Fraction(len(q), total) for q in queues]
    deficit, at, out = [Fraction(0)] * len(queues), [0] * len(queues), []
    for x in range(0, total, window):
        size, spare = min(window, total - x), Fraction(0)
        for k, q in enumerate(queues):
            deficit[k] += share[k] * size
            serve = (spare + deficit[k]) // 1
            assert serve >= 0
            out += q[at[k] : at[k] + serve]
            at[k] += serve
            deficit[k] -= serve
            spare += deficit[k]
            assert -1 < deficit[k] < 1
        assert spare == 0  # a window is filled by whole tokens
    return out


def packed(own_turns, totals, length, window, step):
    place = {}
    for q, n in totals.items():
        for first in range(0, n, step):
            for start, take, at in packing.pieces(own_turns[q], first, min(step, n - first), length, window):
                for k in range(take):
                    assert at + k not in place
                    place[at + k] = (q, start + k)
    return [place[k] for k in range(len(place))]


@pytest.mark.parametrize("window", [32, 128, 1024])
@pytest.mark.parametrize(
    "own", [{"a": 1000, "b": 500, "c": 77}, {"a": 3000, "b": 1, "c": 2, "d": 1}, {f"q{i}": 1 + i % 3 for i in range(400)}, {"a": 2000, **{f"q{i}": 7 for i in range(90)}}, {"z": 5}]
)
def test_closed_form_is_the_round_robin(own, window):
    table = packing.lanes(own, window)
    total = sum(own.values())
    assert all(lane * window >= total for _, lane, _ in table.values())
    own_turns = {q: [packing.Turn(0, total, 0, n, *table[q])] for q, n in own.items()}
    assert packed(own_turns, own, 32, window, 13) == literal(own, window)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 3, "b": 1, "c": 0.001}, {"a": 1, "b": 1e-9, "c": 1e9}])
def test_targets_other_than_the_shares(weights):
    totals = {"a": 1000, "b": 500, "c": 77}
    own_turns = packing.turns(totals, weights, 128)
    got = packed(own_turns, totals, 32, 128, 13)
    assert len(got) == 1577
    for q, n in totals.items():
        assert [i for p, i in got if p == q] == list(range(n))
    for start in sorted({t.start for ts in own_turns.values() for t in ts}):
        own = {q: t.own for q, ts in own_turns.items() for t in ts if t.start == start}
        served = {q: t.before for q, ts in own_turns.items() for t in ts if t.start == start}
        assert got[start : start + sum(own.values())] == [(q, served[q] + i) for q, i in literal(own, 128)]
    first = {q: ts[0].own for q, ts in own_turns.items() if ts and ts[0].start == 0}
    for q, n in first.items():
        assert abs(n - sum(first.values()) * weights[q] / sum(weights.values())) <= len(weights)


@pytest.mark.parametrize("window_sequences", [1, 64])
def test_very_many_sources(spark, window_sequences):
    """Each source keeps its own name and weight, however many there are, and no token is lost or doubled."""
    rows = [(i, "one two three four five " * 4, ("a", "b")[i % 2] if i < 400 else f"s{i}") for i in range(5400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights, share in (({"a": 3.0, "b": 1.0, "nobody": 2.0}, 0.75), ({"b": 1.0}, 0.0), (None, 200 / 5400)):
        got = packing.pack(df, PATH, P.PATTERN, length=64, window_sequences=window_sequences, weights=weights).collect()
        check(got, rows, 64)
        assert len({r["source"] for r in got}) == 5002
        head = [r for r in got if r["sequence_id"] < 64]
        n = sum(r["length"] for r in head)
        assert abs(sum(r["length"] for r in head if r["source"] == "a") - share * n) <= 2


def test_fast_encoder_equals_the_library():
    enc, tk = packing.Encoder(PATH, P.PATTERN), Tokenizer.from_file(PATH)
    assert enc.fast is not None
    for t in ["", " ", "it's  the\n\n\tend ", "naïve Übung 123 4567", "日本語 テキスト", "a b c​d", "\x00\x1c\x1f", "😀👍🏽 !!?", "<|endoftext|>x", "é" * 300]:
        assert enc(t) == tk.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    enc = packing.Encoder(str(path), P.PATTERN)
    assert enc.fast is None and enc("words here") == Tokenizer.from_file(str(path)).encode("words here", add_special_tokens=False).ids


def test_query_digest(spark, tmp_path):
    from cytolake.llm.queries import QUERIES

    docs(spark, [(1, "one two three", "a"), (2, None, "b")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_mixture_packing"](spark, str(tmp_path)).collect()
    ids = {1: [*Tokenizer.from_file(PATH).encode("one two three", add_special_tokens=False).ids, 0], 2: [0]}
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part)

