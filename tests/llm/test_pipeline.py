import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from cytolake.llm import secret_forest

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
RNG = np.random.default_rng(21)
LETTERS = list("etaoinshrdlucmfgyp")
WORDS = ["".join(RNG.choice(LETTERS, int(n))) for n in RNG.integers(1, 9, 3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def rows():
    passage = prose(90)
    out = [(i, prose(int(RNG.integers(80, 300)))) for i in range(30)]
    out += [(100 + i, f"{prose(120)} {passage} {prose(60)}") for i in range(4)]
    out += [(200 + i, out[3][1]) for i in range(3)] + [(210, out[4][1] + " added")]
    out += [(300, f'{prose(100)} token = "{HEX}" {prose(50)}'), (400, "short"), (401, None), (402, ""), (403, "same words " * 200), (None, prose(100)), (5, out[5][1])]
    return [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in out]


ROWS = rows()
LABELS = [(i, int(i < 30), 0) for i in range(0, 300) if i % 7]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute(data, forest_of):
    """The documents that reach packing, as {id: text}, one stage after another, each by the plain version of its test."""
    from test_cdc_dedup import brute_chunks
    from test_compression_bands import plain_fit, plain_verdict
    from test_secret_forest import plain_scan
    from test_simhash import brute_components

    fitted = plain_fit([r[:3] for r in data], [r[:2] for r in LABELS])
    kept = [(d, t) for d, t, lang, *_ in data if plain_verdict(t, lang, fitted)[1]]
    stay = {d for d, _, c, _ in brute_components(kept) if d is not None and d == c}
    texts = {}
    for d, t in sorted(kept, key=lambda r: r[1]):
        if d is None or d in stay:
            texts.setdefault(d, t)
    seen, out = {}, {}
    for d in sorted(x for x in texts if x is not None):
        for k, (_, g) in enumerate(brute_chunks(texts[d])):
            seen.setdefault(g, (d, k))
    for d, t in texts.items():
        words = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
        keep, at, run, done = "", 0, 0, 0
        for k, (n, g) in enumerate([*brute_chunks(t), (0, None)]):
            if g is not None and d is not None and seen[g] != (d, k):
                run += n
            else:
                if run >= 25:
                    keep, done = keep + t[done : words[at - run]], words[at]
                run = 0
            at += n
        text = keep + t[done:]
        if text.split():
            out[d] = text
    forest = forest_of(out)
    for d, text in out.items():
        for start, secret, _ in reversed(plain_scan(text, forest)):
            text = text[:start] + secret_forest.MASK + text[start + len(secret) :]
        out[d] = text
    return out


def test_pipeline_matches_brute_force(spark, folder):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(ROWS, lambda texts: secret_forest.fit(spark, usual=secret_forest.language(frame(texts), labels)))
    assert len(want) <= len(ROWS) - 8 and any(secret_forest.MASK in t for t in want.values())
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in C.run(spark, folder).collect():
        got.setdefault(r["doc_id"], [r["doc_tokens"], 0])
        got[r["doc_id"]][1] += r["length"]
    sizes = {d: len(tk.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert {d: n for d, (n, m) in got.items() if n == m} == sizes


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs.withColumn("_id", docs["doc_id"]), folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out.cache()
        counts.append(docs.count())
        bad = docs.where("n_chars != length(text)").count()
        assert bad == 0
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[4]
    assert docs.where(f"text like '%{HEX}%'").count() == 0


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0
