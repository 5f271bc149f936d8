import numpy as np
import pytest
import xxhash

from cytolake.llm import cdc_dedup as D

HOW = D.Chunking()
RNG = np.random.default_rng(12)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzé"), int(n))) for n in RNG.integers(1, 9, 4000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def brute_chunks(text):
    """(words of each chunk, digest), by rolling the hash byte after byte."""
    words = [w.encode() for w in text.split()] if text else []
    g, h, out, own = [int(x) for x in D.gear(HOW.seed)], 0, [], []
    for k, w in enumerate(words):
        for b in (b" " if k else b"") + w:
            h = ((h << 1) + g[b]) & 0xFFFF
        own.append(w)
        if h < 65536 // HOW.mean_words or len(own) == HOW.max_words or k == len(words) - 1:
            out.append((len(own), xxhash.xxh3_64_intdigest(b" ".join(own))))
            own = []
    return out


@pytest.mark.parametrize("text", ["", " \n", "one", "two  words", prose(RNG, 400), "same " * 300, " \tlead and trail \r\n" + prose(RNG, 30) + "\n"])
def test_chunks(text):
    c = D.chunk(text.encode(), HOW)
    want = brute_chunks(text)
    if not want:
        assert c is None
        return
    assert list(zip(c.words.tolist(), c.digest.view(np.uint64).tolist(), strict=True)) == want
    raw = text.encode()
    assert b" ".join(raw[a:b] for a, b in zip(c.start, c.end, strict=True)).split() == raw.split()


def test_insertions_move_no_later_boundary():
    text = prose(np.random.default_rng(1), 2000)
    a = set(D.chunk(text.encode(), HOW).digest.tolist())
    b = D.chunk(("inserted words " + text[:3000] + " more " + text[3000:]).encode(), HOW).digest.tolist()
    assert sum(x not in a for x in b) <= 6


def brute_spans(rows):
    seen, out = {}, []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for doc, text in order:
        for k, (_, d) in enumerate(brute_chunks(text)):
            seen.setdefault(d, (doc, k))
    for doc, text in order:
        run = 0
        for k, (n, d) in enumerate([*brute_chunks(text), (0, None)]):
            if d is not None and seen[d] != (doc, k):
                run += n
            else:
                out += [(doc, run)] if run >= HOW.min_words else []
                run = 0
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    passages = [prose(rng, int(n)) for n in rng.integers(50, 120, 8)]
    rows = []
    for i in range(60):
        text = prose(rng, 150)
        if i % 2:
            p = passages[i % 8]
            text += (" " if i % 3 else "\n") + (p if i % 4 == 1 else p.replace(" ", "\n", 3)) + " " + prose(rng, 40)
        rows.append((i, text))
    return rows, passages


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", 4) for r in rows], "doc_id long, text string, lang string, start int").repartition(4)


def test_spans_match_brute_force(spark):
    rows, _ = corpus()
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, " \n "), (None, rows[0][1]), (104, rows[3][1] + " " + rows[3][1])]
    got = D.spans(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == brute_spans(rows)
    texts = dict(rows)
    for r in got:
        assert texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode() == r["passage"]
        assert r["first_id"] <= r["doc_id"] and len(r["passage"].split()) == r["n_words"]


def test_passages_of_fifty_words_are_caught_and_clean_text_is_left(spark):
    rows, passages = corpus()
    got = {r["doc_id"]: r for r in D.cut(frame(spark, rows)).collect()}
    firsts = {}
    for i, text in rows:
        cut = got[i]["text"]
        if i % 2 == 0 or firsts.setdefault(i % 8, i) == i:
            assert cut == text and got[i]["removed_words"] == 0
        else:
            assert got[i]["removed_words"] >= 25 and passages[i % 8][100:200] not in " ".join(cut.split())
            assert len(cut.split()) >= 190
            assert len(cut.split()) + got[i]["removed_words"] == len(text.split())
    assert len(got) == len(rows)


def test_rows_that_repeat_an_id_and_empty_tables(spark):
    text = prose(np.random.default_rng(3), 200)
    rows = [(1, text), (1, text), (1, "something else " + text), (2, None), (None, text)]
    got = D.cut(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "start", "removed_words"]
    kept = [r["text"] for r in got.collect() if r["doc_id"] == 1]
    assert kept.count(text) == 2 and len(kept) == 3
    assert [r["text"] for r in got.where("doc_id is null").collect()] == [text]
    empty = frame(spark, rows).limit(0)
    assert D.cut(empty).count() == 0 and D.spans(empty).count() == 0


def test_no_passage_of_over_fifty_words_is_lost():
    rng = np.random.default_rng(21)
    lost_by_chunks = 0
    for i in range(3000):
        p = prose(rng, int(rng.integers(51, 61)))
        a = D.chunk(f"{prose(rng, 30)} {p} {prose(rng, 20)}".encode(), HOW)
        text = f"{prose(rng, int(rng.integers(0, 40)))} {p} {prose(rng, 9)}".encode()
        b = D.chunk(text, HOW)
        found = D.runs(b, 2, dict.fromkeys(a.digests().tolist(), 1), HOW)
        at = text.index(p.encode())
        assert len(found) == 1 and found[0][3] >= HOW.min_words and found[0][4] == 1, (i, p)
        assert found[0][0] < at + len(p.encode()) and found[0][1] > at
        shared = set(a.digest.tolist())
        run = longest = 0
        for n, d in zip(b.words.tolist(), b.digest.tolist(), strict=True):
            run = run + n if d in shared else 0
            longest = max(longest, run)
        lost_by_chunks += longest < HOW.min_words
    assert lost_by_chunks > 50


def test_a_passage_without_a_run_of_chunks_is_found_whole(spark):
    rng = np.random.default_rng(22)
    while True:
        p = prose(rng, 51)
        if len(D.chunk(p.encode(), HOW).window):
            break
    rows = [(i, f"{prose(rng, 60)} {p} {prose(rng, 60)}") for i in (1, 2)]
    rows += [(3, p), (4, prose(rng, 300))]
    got = sorted(D.spans(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["first_id"], r["passage"]) for r in got] == [(i, 51, 1, p) for i in (2, 3)]
    twice = f"{prose(rng, 60)} {p} {prose(rng, 60)} {p} {prose(rng, 60)}"
    got = D.spans(frame(spark, [(7, twice)])).collect()
    assert [(r["n_words"], r["first_id"], r["start"]) for r in got] == [(51, 7, len(twice[: twice.rindex(p)].encode()))]


def test_one_equal_digest_cuts_nothing():
    rng = np.random.default_rng(30)
    long = bare = 0
    while not (long and bare):
        c = D.chunk(prose(rng, 1500).encode(), HOW)
        for k, twin in c.twin.items():
            long += 1
            assert D.runs(c, 2, {int(c.digest[k]): 1}, HOW) == []
            assert D.runs(c, 2, {int(c.digest[k]): 1, twin: 1}, HOW)[0][3] == c.words[k]
        for i, inner in enumerate(c.inner.tolist()):
            digest, second = int(c.window_digest[i]), int(c.digest[inner]) if inner >= 0 else c.window_twin[i]
            assert D.runs(c, 2, {digest: 1}, HOW) == []
            assert [f[3] for f in D.runs(c, 2, {digest: 1, second: 1}, HOW)] == [51]
            if inner >= 0:
                assert c.first[c.window[i]] <= c.start[inner] and c.end[inner] <= c.last[c.window[i] + 50]
            bare += inner < 0


def test_columns_of_any_name_stay(spark):
    rows, _ = corpus()
    names = ["_id", "_repeats", "_text", "digest", "first", "_digests", "start"]
    df = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    plain = {r["doc_id"]: r["text"] for r in D.cut(frame(spark, rows)).collect()}
    got = D.cut(df)
    assert got.columns == ["doc_id", "text", *names, "removed_words"]
    for r in got.collect():
        assert r["text"] == plain[r["doc_id"]] and all(r[n] == f"{n}{r['doc_id']}" for n in names)
    assert D.spans(df).count() == D.spans(frame(spark, rows)).count()
