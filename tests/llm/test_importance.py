import numpy as np
import pytest
import xxhash

from cytolake.llm import importance as I

MODEL = I.Model(buckets=500, target_rows=500)


def buckets(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(w, MODEL.seed) for w in words]
    m, out = 2**64 - 1, [x % MODEL.buckets for x in h]
    for a, b in zip(h, h[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 & m) ^ (b >> 7) ^ (b << 21 & m)
        out.append((p ^ p >> 29) % MODEL.buckets)
    return out


def brute(rows, labels, share):
    good = {d for d, q, t in labels if q == 1 and t != 1 and d is not None}
    raw, target = np.ones(MODEL.buckets), np.ones(MODEL.buckets)
    for d, t in rows:
        for b in buckets(t):
            raw[b] += 1
            target[b] += d in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    keys = []
    for d, t in rows:
        w = ratio[buckets(t)].sum() if buckets(t) else 0.0
        u = (xxhash.xxh64_intdigest(str(d), MODEL.seed + 1) + 0.5) / 2.0**64
        keys.append((d, w, w - np.log(-np.log(u))))
    least = sorted((k for _, _, k in keys), reverse=True)[round(share * len(rows)) - 1]
    return [(d, w, k, k >= least) for d, w, k in keys]


def corpus():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(200):
        fine = i % 5 != 0
        words = ["the", "plain", "text", "reads", "well", "and", "on"] if fine else ["BUY", "$$$", "now", "!!!", "the", "click"]
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(5, 60))))))
        if i % 3 == 0:
            labels.append((i, int(fine), 0))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, log_weight double").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    rows, labels = corpus()
    rows += [(300, None), (301, ""), (None, "the plain text"), (5, rows[5][1])]
    labels += [(None, 1, 0), (7, None, 0), (8, 1, None)]
    docs, lab = frames(spark, rows, labels)
    got = I.resample(docs, lab, share=0.7, model=MODEL).collect()
    want = brute(rows, labels, 0.7)
    order = lambda x: (str(x[0]), x[1])
    for g, w in zip(sorted(((r["doc_id"], r["log_weight"], r["gumbel_key"], r["kept"]) for r in got), key=order), sorted(want, key=order), strict=True):
        assert g[0] == w[0] and g[3] == w[3] and np.allclose(g[1:3], w[1:3])


def test_held_out_accuracy_and_default_share(spark):
    rows, labels = corpus()
    docs, lab = frames(spark, rows, labels)
    got = {r["doc_id"]: r["kept"] for r in I.resample(docs, lab, model=MODEL).collect()}
    held = [i for i in got if i % 3]
    assert np.mean([got[i] == (i % 5 != 0) for i in held]) > 0.9
    share = sum(q for _, q, _ in labels) / len(labels)
    assert sum(got.values()) == round(share * len(rows))


def test_the_target_sample_is_bounded(spark):
    docs, lab = frames(spark, *corpus())
    a, b = (I.resample(docs, lab, model=I.Model(buckets=500, target_rows=10)).collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 200


def test_empty_tables(spark):
    docs, lab = frames(spark, *corpus())
    assert I.resample(docs.limit(0), lab).count() == 0
    assert I.resample(docs, lab.limit(0)).where("kept").count() == docs.count()
    assert I.resample(docs, lab, share=0.0).where("kept").count() == 0


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100, 101, 0])
def test_threshold(spark, k):
    rng = np.random.default_rng(k)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 60), rng.integers(-5, 5, 40)]).tolist()
    got = I.threshold(spark.createDataFrame([(v,) for v in values], "v long"), "v", k)
    assert got == (sorted(values, reverse=True)[k - 1] if 0 < k <= 100 else None)
