"""Token counts against the library itself."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cytolake.llm import token_counts as T

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(P.path(FILE))
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return T.Counts(P.path(FILE), P.PATTERN)


def test_every_proof_holds(own, library):
    """Strings of the vocabulary that are proved are one token; the others are not, or are no pre-token."""
    assert own.proven > 49_000
    assert all(library(t) == 1 for t in list(own.known)[: own.proven])
    alphabet = T._byte_alphabet()
    for token in Tokenizer.from_file(P.path(FILE)).get_vocab():
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in own.known:
            assert library(text) > 1 or text == "<|endoftext|>" or own.pattern.findall(text) != [text]


ALPHABET = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​ 　﻿'sdmtrevlLÉé中١²Ⅷ_-.,!🙂́\x00", "\r\n", "<|endoftext|>", "<|endoftext|", " the", "tion", "'ll", "'LL", "👩‍👩‍👧"]


def test_random_texts(own, library):
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 15)))
        assert own(text) == library(text), text


def test_long_texts_and_a_full_memo(own, library, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices([*ALPHABET, *"abcdefgh    "], k=30_000))
    want = library(text)
    monkeypatch.setattr(T, "LONG", 1000)
    monkeypatch.setattr(T, "PIECE", 77)
    monkeypatch.setattr(T, "MEMO", 50)
    assert own(text) == want
    assert len(own.known) <= own.proven + 50
    assert own("x" * 300_000) == library("x" * 300_000)


def test_rows(spark, library):
    texts = [None, "", "word", "a<|endoftext|>b", "word " * 1024, "word " * 1023, "é\n\n", "word " * 700_000]
    rows = [(i % 6 or None, t, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = T.count_tokens(df, P.path(FILE), P.PATTERN)
    want = sorted(((d, len((t or "").encode()), n := library(t or ""), n > 1024) for d, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert T.count_tokens(df.limit(0), P.path(FILE), P.PATTERN).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_are_refused(name):
    with pytest.raises(ValueError):
        T.Counts(P.path(name), P.PATTERN)
