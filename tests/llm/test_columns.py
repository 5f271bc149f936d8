"""Every operator on rows with columns that bear the names that the operators use inside."""

import re
from pathlib import Path

import public_tokenizers as P
import pytest

from cytolake.llm import bpe_replay, cdc_dedup, compression_bands, hash_tree, hnsw, importance, merkle, packing, secret_forest, simhash, token_counts, url_lists, vector_codes

SOURCE = Path(bpe_replay.__file__).parent
OWN = {"doc_id", "text", "source", "lang", "embedding", "label", "vec_id", "url", "page_id", "fetched_at", "quality", "toxic", "list", "pattern", "action", "at"}
RESULTS = {"kept", "node", "component", "component_id", "start", "length", "digest", "first", "src", "dst", "fp", "rep", "n", "size", "key", "space", "v", "turns", "votes", "shard", "slot", "ids", "ratio"}
NAMES = sorted(({n for f in SOURCE.glob("*.py") for n in re.findall(r"[\"'](_[a-z0-9_]{0,20})[\"']", f.read_text())} | RESULTS) - OWN)
TEXT = " ".join(f"word{i % 37} of{i % 11} text{i}" for i in range(60))
ROWS = [(1, TEXT, "a", "en"), (2, TEXT + " more", "b", "en"), (3, None, None, None), (4, "", "a", "fr"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a", "en")]


def frames(spark, rows, kinds):
    plain = spark.createDataFrame(rows, kinds).coalesce(1)
    wide = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], kinds + ", " + ", ".join(f"`{n}` string" for n in NAMES)).coalesce(1)
    return plain, wide


def docs(spark):
    return frames(spark, ROWS, "doc_id long, text string, source string, lang string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")


def pages(spark, df):
    entries = spark.createDataFrame([("l", "a.org", "add", 3)], "list string, pattern string, action string, at long")
    return url_lists.judge(df, entries)


DOCUMENTS = {
    "pack": lambda s, df: packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN),
    "simhash": lambda s, df: simhash.near_dedup(df),
    "scan": lambda s, df: secret_forest.scan(df),
    "redact": lambda s, df: secret_forest.redact(df),
    "shards": lambda s, df: hash_tree.assign(df),
    "bpe": lambda s, df: bpe_replay.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "spans": lambda s, df: cdc_dedup.spans(df),
    "cut": lambda s, df: cdc_dedup.cut(df),
    "resample": lambda s, df: importance.resample(df, labels(s)),
    "rules": lambda s, df: compression_bands.quality_rules(df, bands=compression_bands.fit(df, labels(s)), lang_col="lang"),
    "tokens": lambda s, df: token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN),
    "manifest": lambda s, df: merkle.prove(merkle.build(df, ["doc_id", "text", "source"])),
    "prints": lambda s, df: simhash.with_fingerprints(df),
}


def same(plain, wide):
    names = plain.columns
    assert set(names) <= set(wide.columns)
    key = lambda df: sorted(str([r[c] for c in names]) for r in df.collect())
    assert key(wide.select(*[f"`{c}`" for c in names])) == key(plain)
    return wide


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents(spark, name):
    plain, wide = docs(spark)
    first = DOCUMENTS[name](spark, plain)
    out = same(first, DOCUMENTS[name](spark, wide))
    extra = [c for c in out.columns if c in NAMES and c not in first.columns]
    if name in ("redact", "cut", "rules", "bpe", "prints"):
        assert len(extra) > len(NAMES) - 12
        assert all(r[c] == "x" for r in out.collect() for c in extra)


def test_vectors_and_pages(spark):
    plain, wide = frames(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1)], "vec_id long, embedding array<double>, label int")
    same(hnsw.near_dedup(plain), hnsw.near_dedup(wide))
    plain, wide = frames(spark, [(1, [1.0, 0.0, 2.0, 1.0], 1), (2, [1.0, 0.01, 0.0, 0.5], 1), (3, None, 1)], "vec_id long, embedding array<double>, label int")
    same(vector_codes.compress(plain).codes, vector_codes.compress(wide).codes)
    plain, wide = frames(spark, [(1, "http://x.a.org/p", 5), (2, None, 5)], "page_id long, url string, fetched_at long")
    same(pages(spark, plain), pages(spark, wide))
