from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cytolake.llm import simhash


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aAbB éÉ\t\n\x0b\x1c  ", max_size=80)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_long_text_goes_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    want = brute_print(text)
    monkeypatch.setattr(simhash, "_STEP", 64)
    assert simhash.fingerprint(text) == want


def brute_components(rows):
    fp = {i: brute_print(t) for i, (_, t) in enumerate(rows)}
    out = []
    for i, (doc, _) in enumerate(rows):
        if doc is None:
            out.append((None, f"{fp[i]:016x}", None, True))
            continue
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in fp if rows[j][0] is not None and (fp[j] ^ fp[k]).bit_count() <= 3} - seen
            seen |= new
            todo += new
        c = min(rows[j][0] for j in seen)
        out.append((doc, f"{fp[i]:016x}", c, doc == c))
    return sorted(out, key=str)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choice(words, 120).tolist()
        for _ in range(int(rng.integers(1, 5))):
            own = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 2))):
                own[at] = "changed"
            rows.append((len(rows) * 3 % 1009, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[1][0], "another text"), (6000, "one"), (6001, "ONE")]
    df = spark.createDataFrame([(a, t, 7) for a, t in rows], "doc_id long, text string, fingerprint int").repartition(3)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in simhash.near_dedup(df).collect()]
    assert sorted(got, key=str) == brute_components(rows)
    assert simhash.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("short,block", [(32, 2048), (2, 16), (1, 7)])
def test_index_loses_no_link_in_dense_groups(spark, short, block):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {0}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    edges = {(r["src"], r["dst"]) for r in simhash.links(nodes, 3, short, block).collect()}
    from cytolake.llm.components import star_edges

    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = star_edges(*np.array(pairs).T)
    got = star_edges(*np.array(sorted(edges)).T)
    assert dict(zip(*map(np.ndarray.tolist, got), strict=True)) == dict(zip(*map(np.ndarray.tolist, want), strict=True))
