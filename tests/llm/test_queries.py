"""Every registered query on the smallest tables, against SQL or the plain version of its operator's test."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cytolake.llm import bpe_replay, importance
from cytolake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", ORACLE)
def test_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_op3(spark):
    from test_simhash import brute_components

    got = QUERIES["op3_simhash_near_dedup"](spark, FOLDER).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in got), key=str) == brute_components(rows(spark, "documents", "doc_id", "text"))


def test_op6(spark):
    codec = bpe_replay.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for d, t in rows(spark, "documents", "doc_id", "text"):
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = QUERIES["op6_bpe_round_trip"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_op8(spark):
    """Every run of repeated chunks is in a span, and a span that holds none is a repeated window of 51 words."""
    from test_cdc_dedup import brute_spans

    docs = rows(spark, "documents", "doc_id", "text")
    got = QUERIES["op8_substring_dedup"](spark, FOLDER).collect()
    words = {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    runs = {}
    for d, n in brute_spans(docs):
        runs[d] = runs.get(d, 0) + n
    assert runs and all(words.get(d, 0) >= n for d, n in runs.items())
    texts = {d: t.encode() for d, t in docs if t}
    earlier = {d: b" ".join(t.split()) for d, t in texts.items()}
    for r in got:
        passage = b" ".join(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].split())
        assert len(passage.split()) == r["n_words"] and r["first_doc_id"] <= r["doc_id"]
        if r["doc_id"] not in runs:
            window = b" ".join(passage.split()[:51])
            assert any(window in t for d, t in earlier.items() if d < r["doc_id"]) or earlier[r["doc_id"]].count(window) > 1


def test_op9(spark, monkeypatch):
    import test_importance

    monkeypatch.setattr(test_importance, "MODEL", importance.Model())
    labels = rows(spark, "labels", "doc_id", "quality", "toxic")
    share = np.mean([q for _, q, _ in labels if q is not None])
    want = test_importance.brute(rows(spark, "documents", "doc_id", "text"), labels, share)
    got = {r["doc_id"]: r for r in QUERIES["op9_importance_resampling"](spark, FOLDER).collect()}
    assert len(got) == len(want)
    for d, w, key, kept in want:
        assert np.allclose((got[d]["log_weight"], got[d]["gumbel_key"]), (w, key)) and got[d]["kept"] == kept


def test_op13(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows(spark, "documents", "doc_id", "text"):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    got = QUERIES["op13_token_counts"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(want)
