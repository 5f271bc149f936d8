import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cytolake.llm import bpe_replay as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = B.Bpe(PATH, P.PATTERN)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def encode(codec, text):
    numbers = codec.number(text)
    codec.learn()
    return codec.ids(numbers).tolist()


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab aAéßü\n\t .,'s123日本", max_size=120)))
def test_as_the_library(text):
    ids = encode(CODEC, text)
    assert ids == ENC.encode_ordinary(text)
    assert CODEC.decode(ids).decode("utf-8", "replace") == text.encode("utf-8", "replace").decode("utf-8", "replace")


def test_awkward_texts():
    for t in ["a" * 3000, "ab" * 700, " " * 500 + "x", "\x00\x1c\x1d\x85   a", "😀" * 90, "aaaaaaab" * 40, "<|endoftext|>"]:
        assert encode(CODEC, t) == ENC.encode_ordinary(t), t[:20]


def test_merges_that_open_lower_ranks(tmp_path):
    # "cd" + "e" = "cde" ranks below "cd": a merge opens one that comes before it in rank order
    tokens = [bytes([b]) for b in range(256)] + [b"cde", b"cd", b"aa", b"aaa", b"aacd"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    codec = B.Bpe(str(path), P.PATTERN)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in ["cde", "xcdecdey", "aaaaa", "aacde", "aaaacdcde", "cdcdcde aacd aaa"]:
        assert encode(codec, t) == enc.encode_ordinary(t), t


def test_words_are_forgotten_and_long_texts_go_in_parts(monkeypatch, spark):
    monkeypatch.setattr(B, "BLOCK_CHARS", 200)
    monkeypatch.setattr(B, "PART_WORDS", 7)
    monkeypatch.setattr(B, "REPLAY_WORDS", 5)
    codec = B.Bpe(PATH, P.PATTERN)
    for t in ["short text", "long text with many words " * 40, "tiny"]:
        assert encode(codec, t) == ENC.encode_ordinary(t)
        codec.forget()


@pytest.mark.parametrize("with_ids", [False, True])
def test_round_trip(spark, with_ids):
    rows = [(1, "Hello wörld,  it's 42!"), (2, None), (3, ""), (None, "no id"), (1, "Hello wörld,  it's 42!"), (4, "x y " * 20_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = B.encode_decode(df, PATH, P.PATTERN, carry=["doc_id", "n_tokens"], with_ids=with_ids).collect()
    want = []
    for d, t in rows:
        ids = ENC.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=str) == sorted(want, key=str)
    if with_ids:
        assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert B.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_columns_of_any_name_are_carried(spark):
    names = ["_text", "_part", "index", "c"]
    df = spark.createDataFrame([(1, "some text", *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = B.encode_decode(df, PATH, P.PATTERN)
    assert got.columns == ["doc_id", "text", *names, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert all(tuple(r)[2:-3] == tuple(names) for r in got.collect())
