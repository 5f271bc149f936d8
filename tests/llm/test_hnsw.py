import numpy as np
import pytest

from cytolake.llm import hnsw

KINDS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, d=16, groups=6, group=12):
    v = rng.normal(size=(n, d))
    for g in range(groups):
        rows = rng.choice(n, group, replace=False)
        v[rows] = rng.normal(size=d) + 0.1 * rng.normal(size=(group, d))
    return v.astype(np.float32)


def brute(rows, least=0.98):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (a, x, k), (b, y, m) = rows[i], rows[j]
            if i != j and None not in (a, b, k, m) and k == m and good(x) and good(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), component, component is None or rows[i][0] == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_links_and_components_match_brute_force(spark, shard_rows):
    v = vectors(np.random.default_rng(4), 260)
    rows = [(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)] * 1 + [(2000 + i, rows[0][1], rows[0][2]) for i in range(4)]
    how = hnsw.Graphs(shard_rows=shard_rows, audit=64)
    got = hnsw.near_dedup(spark.createDataFrame(rows, KINDS).repartition(3), how=how).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, nan], 0),
        (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (12, [-0.0, 2e-30], 1), (13, [0.0, 3e30], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], KINDS + ", component_id string")
    got = hnsw.near_dedup(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)
    assert hnsw.near_dedup(df.limit(0)).count() == 0


def test_graph_search_recalls_neighbours():
    v = hnsw._unit(list(vectors(np.random.default_rng(6), 1500, 32)))
    index = hnsw.Hnsw(v, hnsw.Graphs())
    got, _ = index.query(v[::10], 64)
    want = np.argsort(-(v[::10] @ v.T), axis=1)[:, :10]
    recall = np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(got, want, strict=True)])
    assert recall >= 0.9


def test_beam_widens_until_the_audit_passes():
    v = hnsw._unit(list(vectors(np.random.default_rng(8), 600, 48, groups=1, group=150)))
    how = hnsw.Graphs(beam=2, audit=600)
    found = hnsw._pairs(hnsw.Hnsw(v, how), v, v, 0.98, how)
    i, j = np.nonzero(v @ v.T >= 0.98)
    assert np.array_equal(found.keys, np.sort(i * len(v) + j)) and found.beam > 2


@pytest.mark.parametrize("n", [3, 48, 700])
def test_links_come_from_the_walk_alone(n):
    """The beam of a search never reaches the width at which a shard is scanned, nor is one left to a scan."""
    v = hnsw._unit(list(vectors(np.random.default_rng(n), n, 24, groups=1, group=min(n, 6))))
    index = hnsw.Hnsw(v, hnsw.Graphs())
    node, sim = index.query(v, min(48, n))
    i, j = np.nonzero(v @ v.T >= 0.98)
    a, b = np.nonzero((sim >= 0.98 - 1e-6) & (node >= 0))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), node[a, b].tolist(), strict=True))


def test_an_audit_without_links_still_measures_recall():
    rng = np.random.default_rng(3)
    v, q = (hnsw._unit(rng.normal(size=(900, 48))) for _ in range(2))
    how = hnsw.Graphs(beam=4, audit=200)
    found = hnsw._pairs(hnsw.Hnsw(v, how), v, q, 0.98, how)
    assert not len(found.keys) and found.beam > 4 and found.near_found >= how.near_recall * found.near_all == how.near_recall * 2000


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.01], 0), (7, [1.0, 0.02], 0), (8, [0.01, 1.0], 0), (5, [1.0, 0.0], 1), (3, [0.0, 2.0], 0)]
    rows += [(9, [1.0, 1.0], 0), (9, [1.0, 1.001], 0), (9, [2.0, 2.0], 0), (9, [1.0, 1.0], 0)]
    got = hnsw.near_dedup(spark.createDataFrame(rows, KINDS)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert got == brute(rows) and (5, 2, 3, False) in got and (5, 2, 5, True) in got


def test_many_shards_of_one_label(spark):
    v = vectors(np.random.default_rng(12), 500, 16, groups=10, group=9)
    rows = [(int(i % 300), x.tolist(), 4) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    how = hnsw.Graphs(shard_rows=30, audit=16)
    got = hnsw.near_dedup(df, how=how).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)
    seen = hnsw.audit(hnsw.search_all(df, how=how)[2]).first()
    assert seen["searches"] == 17**2 and seen["near_recall"] >= 0.9


@pytest.mark.parametrize("shard_rows", [90, 10_000])
def test_dense_queries_are_counted_by_stripes(spark, monkeypatch, shard_rows):
    """Groups of near-equal vectors beside spread ones, with copies, in one shard and in many, as lists and as stripes."""
    rng = np.random.default_rng(21)
    v = rng.normal(size=(330, 16))
    v[:150] = rng.normal(size=16) + 0.02 * rng.normal(size=(150, 16))
    v[150:230] = rng.normal(size=16) + 0.12 * rng.normal(size=(80, 16))
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v.astype(np.float32))]
    rows += [(1000 + i, rows[i][1], 1) for i in (0, 0, 3, 160, 300)]
    want = brute(rows)
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    run = hnsw._tile
    for listed in (1 << 22, 0, 3_000):
        def tile(least, how, listed=listed):  # the bound as the tasks see it
            own = run(least, how)

            def held(left, right):
                hnsw._LISTED = listed
                return own(left, right)

            return held

        monkeypatch.setattr(hnsw, "_tile", tile)
        got = hnsw.near_dedup(df, how=hnsw.Graphs(shard_rows=shard_rows, audit=32, beam=16)).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == want


def test_a_shard_of_near_equal_vectors_takes_memory_for_its_nodes_alone():
    import tracemalloc

    rng = np.random.default_rng(2)
    n, how = 6_000, hnsw.Graphs(audit=64)
    v = hnsw._unit(rng.normal(size=32) + 1e-3 * rng.normal(size=(n, 32)))
    import pandas as pd

    frame = pd.DataFrame({"key": [f"{i:08d}" for i in range(n)], "v": list(v), "node": np.arange(n), "copies": np.ones(n, dtype=np.int64), "space": "s", "shard": 0, "shards": 1})
    graph = hnsw._build(how)(frame)
    side = graph.assign(a=0, b=0)
    tracemalloc.start()
    out = hnsw._tile(0.98, how)(side, side)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6  # the links as a list would be 288 MB, several times
    assert (out[out["links"] > 0]["links"] == n - 1).all() and (out["links"] > 0).sum() == n
    assert ((out["links"] == 0) & (out["node"] >= 0)).sum() == n - 1


def _walks(monkeypatch):
    """(graph, width) to the number of queries that walk."""
    seen, run = {}, hnsw.Hnsw.query

    def query(self, q, beam):
        seen[id(self), beam] = seen.get((id(self), beam), 0) + len(q)
        return run(self, q, beam)

    monkeypatch.setattr(hnsw.Hnsw, "query", query)
    return seen


def test_beams_that_fail_the_audit_are_walked_by_its_sample_alone(monkeypatch):
    rng = np.random.default_rng(3)
    v, q = (hnsw._unit(rng.normal(size=(900, 48))) for _ in range(2))
    how = hnsw.Graphs(beam=4, audit=100)
    index = hnsw.Hnsw(v, how)
    seen = _walks(monkeypatch)
    found = hnsw._pairs(index, v, q, 0.98, how)
    widths = {beam: n for (_, beam), n in seen.items()}
    assert len(widths) > 2 and widths.pop(found.beam) == 100 + 900 and set(widths.values()) == {100}


def test_two_shards_are_searched_one_way_but_for_vectors_that_walks_do_not_find(monkeypatch):
    import pickle

    import pandas as pd

    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=(400, 32)).astype(np.float32) for _ in range(2))
    b[7] = a[11] + 0.001
    how = hnsw.Graphs(audit=10)

    def shard(v, k):
        return hnsw._build(how)(pd.DataFrame({"key": [f"{i:08d}" for i in range(len(v))], "v": list(v), "node": np.arange(len(v)) + 1000 * k, "copies": np.ones(len(v), dtype=np.int64), "space": "s", "shard": k, "shards": 2})).assign(a=0, b=1)

    left, right = shard(a, 0), shard(b, 1)
    node, copies, v, layers, unfound = pickle.loads(right["graph"].iloc[0])
    assert not len(unfound)
    blind = [(m, np.where(g == 7, -1, g)) for m, g in layers if 7 not in m[:1]]  # no walk arrives at it
    for graph, lost, links in ((layers, [], 1), (blind, [], 0), (blind, [7], 1)):
        seen = _walks(monkeypatch)
        out = hnsw._tile(0.98, how)(left, right.assign(graph=[pickle.dumps((node, copies, v, graph, np.array(lost, dtype=np.int64)), 5)]))
        got = out[out["links"] > 0].set_index("node")["links"].to_dict()
        assert got == ({11: 1, 1007: 1} if links else {})
        assert sum(seen.values()) < 400 + 10 * 2 * 8 + 10  # each of a once, and samples of both
        monkeypatch.undo()
