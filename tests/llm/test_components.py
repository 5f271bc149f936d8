import numpy as np
import pytest

from cytolake.llm.components import connected_components, star_edges


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("one_task", [0, 10**6])
@pytest.mark.parametrize("shape", ["path", "star", "random", "none", "loops"])
def test_components(spark, shape, one_task):
    rng = np.random.default_rng(1)
    edges = {
        "path": [(i + 1, i) for i in rng.permutation(60).tolist()],
        "star": [(7, i) for i in range(100, 160)] + [(i, 5) for i in (100, 200)],
        "random": [tuple(x) for x in rng.integers(0, 200, (120, 2)).tolist()],
        "none": [],
        "loops": [(1, 1), (2, 3), (3, 2), (None, 4), (5, None)],
    }[shape]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(4), one_task=one_task).collect()}
    want = brute([e for e in edges if None not in e and e[0] != e[1]])
    assert got == want


def test_star_edges():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 300, (200, 2))
    node, root = star_edges(e[:, 0], e[:, 1])
    want = {x: r for x, r in brute(e.tolist()).items() if x != r}
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want
    assert len(star_edges(e[:0, 0], e[:0, 1])[0]) == 0
