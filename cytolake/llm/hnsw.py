"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors of a label are dealt to shards of bounded size, and each shard gets a graph
of its own: few nodes on the upper layers, all on the lowest, every node linked to
near and diverse neighbours. Every two shards meet in a task, where all vectors of one
walk the other's graph, and a shard's vectors walk their own. The few that a walk towards
themselves does not find walk the other way instead, since nothing else might find them. An audit
compares a sample with brute force, by its nearest neighbours whether they are links
or not and by its links, and the beam is widened until both are found, for each pair
of shards anew, before all other vectors are searched at that beam. What the search finds is verified by cosine in double precision;
links are counted in the task, and only a spanning forest leaves it, so a dense group
never becomes rows of pairs.

Equal vectors of a label are one node that counts as often as it occurs. Links and
components are of nodes; ids come in at the end, so that rows of one id stay apart.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, save
from .components import connected_components, star_edges


@dataclass(frozen=True)
class Graphs:
    """shard_rows: most vectors in a shard, about; links: of a node on upper layers, twice as
    many on the lowest; build_beam and beam: first widths; audit: vectors that an audit
    compares with brute force; recall: of the audit's links, and near_recall: of its ``near``
    nearest neighbours in the shard, below either of which the beam is made half as wide again."""

    shard_rows: int = 16_384
    links: int = 16
    build_beam: int = 48
    beam: int = 48
    audit: int = 512
    recall: float = 1.0
    near: int = 10
    near_recall: float = 0.95


_QUERIES = 256  # searched in lockstep
#: Partitions for each shard or pair of shards, and most of them: a task is many seconds for few bytes, so that partitions
#: merged by their bytes would leave cores idle.
_SPREAD, _PARTS = 4, 8192
_SELF = 16  # beam with which a vector is looked for in its own graph, far narrower than those of searches
_STRIPE = 256  # queries compared with a whole shard at once
#: Links that a search may hold as a list beside those of its first beams. Where queries with full beams may have more of them,
#: they are counted and joined stripe by stripe, so a tile's memory does not grow with its links.
_LISTED = 1 << 22


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, best first."""
    if sim.shape[1] > k:
        part = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-sim, axis=1, kind="stable")


def _some(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, in any order."""
    return np.argpartition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k :] if sim.shape[1] > k else np.broadcast_to(np.arange(sim.shape[1]), sim.shape)


def search(v: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of one layer for many queries at once: (nodes, similarities), best first, -1 where none.

    ``graph``: neighbours by node, -1 for none; ``entry``: start nodes by query."""
    out_n = np.full((len(q), beam), -1, dtype=np.int64)
    out_s = np.full((len(q), beam), -np.inf, dtype=np.float32)
    for at in range(0, len(q), _QUERIES):
        n, s = _search(v, graph, q[at : at + _QUERIES], entry[at : at + _QUERIES], beam)
        out_n[at : at + _QUERIES], out_s[at : at + _QUERIES] = n, s
    return out_n, out_s


def _search(v, graph, q, entry, beam):
    rows, wide = len(q), min(max(4, beam // 16), 16)  # nodes expanded in a step
    seen = np.zeros((rows, len(v) + 1), dtype=bool)
    seen[:, -1] = True  # stands for "none": -1 is the last column
    flags = seen.reshape(-1)
    node = np.full((rows, beam), -1, dtype=np.int64)
    sim = np.full((rows, beam), -np.inf, dtype=np.float32)
    k = min(entry.shape[1], beam)
    node[:, :k] = entry[:, :k]
    got = node[:, :k] >= 0
    sim[:, :k] = np.where(got, np.einsum("rkd,rd->rk", v[node[:, :k]], q), -np.inf)
    np.put_along_axis(seen, node[:, :k], True, 1)
    done = node < 0
    active = np.arange(rows)
    while len(active):
        pending = np.where(done[active], -np.inf, sim[active])
        pick = _some(pending, wide)
        live = np.isfinite(np.take_along_axis(pending, pick, 1))
        some = live.any(1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        a_node, a_done = node[active], done[active]
        np.put_along_axis(a_done, pick, np.take_along_axis(a_done, pick, 1) | live, 1)
        near = np.where(live[:, :, None], np.take(graph, np.take_along_axis(a_node, pick, 1), axis=0), -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        at = (active * (len(v) + 1))[:, None] + np.where(near < 0, len(v), near)
        new = ~np.take(flags, at)
        flags[at[new]] = True
        near = np.where(new, near, -1)
        x, ends = np.take(v, near[new], axis=0), np.cumsum(new.sum(1))
        found = np.empty(len(x), dtype=np.float32)
        for r, start, end in zip(active.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
            np.dot(x[start:end], q[r], out=found[start:end])
        s = np.full(near.shape, -np.inf, dtype=np.float32)
        s[new] = found
        all_n = np.concatenate([a_node, near], axis=1)
        all_s = np.concatenate([sim[active], s], axis=1)
        all_d = np.concatenate([a_done, near < 0], axis=1)
        best = _some(all_s, beam)
        node[active] = np.take_along_axis(all_n, best, 1)
        sim[active] = np.take_along_axis(all_s, best, 1)
        done[active] = np.take_along_axis(all_d, best, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)


def _diverse(v: np.ndarray, cand: np.ndarray, sim: np.ndarray, keep: int) -> np.ndarray:
    """For each row, up to ``keep`` candidates, nearest first, that are nearer to the row's node than to
    any one taken; what is left of ``keep`` goes to the nearest of the rest. Candidates come best first."""
    rows, width = cand.shape
    out = np.full((rows, keep), -1, dtype=np.int64)
    count = np.zeros(rows, dtype=np.int64)
    spare = np.zeros((rows, width), dtype=bool)
    for c in range(width):
        x = cand[:, c]
        ok = (x >= 0) & (count < keep)
        if not ok.any():
            continue
        r = np.flatnonzero(ok)
        taken = out[r]
        between = np.einsum("nkd,nd->nk", v[taken], v[x[r]])
        worse = ((between > sim[r, c][:, None]) & (taken >= 0)).any(1)
        good = r[~worse]
        out[good, count[good]] = x[good]
        count[good] += 1
        spare[r[worse], c] = True
    for c in range(width):
        r = np.flatnonzero(spare[:, c] & (count < keep))
        out[r, count[r]] = cand[r, c]
        count[r] += 1
    return out


def _layer(v: np.ndarray, members: np.ndarray, above: int, upper, keep: int, beam: int) -> np.ndarray:
    """The graph of one layer over ``members``, of which the first ``above`` are the layer above.

    Nodes come in batches that grow with the graph; a batch is searched in the graph so far
    and compared within itself, so that copies that come together are linked too."""
    graph = np.full((len(v) + 1, keep), -1, dtype=np.int64)
    graph_sim = np.full((len(v) + 1, keep), -np.inf, dtype=np.float32)
    at = 0
    while at < len(members):
        batch = members[at : at + (max(48, above) if not at else max(48, min(at // 4, 1024)))]
        own = v[batch] @ v[batch].T
        np.fill_diagonal(own, -np.inf)
        k = min(beam // 2, len(batch) - 1)
        nodes, sims = [], []
        if k > 0:
            top = _top(own, k)
            nodes.append(batch[top])
            sims.append(np.take_along_axis(own, top, 1))
        if at:
            start = upper(v[batch], members[:at])
            n, s = search(v, graph[:-1], v[batch], start, beam)
            nodes.append(n)
            sims.append(s)
        at += len(batch)
        if not nodes:
            continue
        cand, sim = np.concatenate(nodes, 1), np.concatenate(sims, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        pick = _diverse(v, cand, sim, keep // 2)
        # new links both ways: what a node has and what it gains are pruned together
        i, j = np.nonzero(pick >= 0)
        src, dst = batch[i], pick[i, j]
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        s = np.einsum("nd,nd->n", v[a], v[b])
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, s = a[new], b[new], s[new]
        touched, first = np.unique(a, return_index=True)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        room = keep // 2
        fits = place < room
        more = np.full((len(touched), room), -1, dtype=np.int64)
        more_s = np.full((len(touched), room), -np.inf, dtype=np.float32)
        row = np.searchsorted(touched, a[fits])
        more[row, place[fits]], more_s[row, place[fits]] = b[fits], s[fits]
        cand, sim = np.concatenate([graph[touched], more], 1), np.concatenate([graph_sim[touched], more_s], 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        full = (cand >= 0).sum(1) > keep
        kept = np.where(full[:, None], -1, cand[:, :keep])
        if full.any():
            kept[full] = _diverse(v, cand[full], sim[full], keep)
        graph[touched] = kept
        graph_sim[touched] = np.where(kept >= 0, np.einsum("nkd,nd->nk", v[kept], v[touched]), -np.inf)
    return graph[:-1]


class Hnsw:
    """A graph over the rows of ``v`` (of length one, 32-bit); row order decides ties and levels."""

    def __init__(self, v: np.ndarray, how: Graphs) -> None:
        self.v, self.how = np.ascontiguousarray(v, dtype=np.float32), how
        rank = np.random.default_rng(17).random(len(v))
        level = np.floor(-np.log(np.maximum(rank, 1e-12)) / np.log(how.links)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: members, graph
        for at in range(int(level.max(initial=0)), -1, -1):
            members = order[level[order] >= at]
            if len(members):
                keep = how.links if at else 2 * how.links
                above = len(self.layers[-1][0]) if self.layers else 0
                self.layers.append((members, _layer(self.v, members, above, self._start, keep, how.build_beam)))

    def _start(self, q: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Start nodes for the next lower layer, by descent through those that are built."""
        entry = None
        for members, graph in self.layers:
            if entry is None:
                entry = np.repeat(members[:1][None, :], len(q), axis=0)
            entry, _ = search(self.v, graph, q, entry, 4)
        if entry is None:
            entry = np.repeat(known[:1][None, :], len(q), axis=0)
        return entry

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, dtype=np.float32)
        entry = None
        for members, graph in self.layers[:-1]:
            entry = np.repeat(members[:1][None, :], len(q), axis=0) if entry is None else entry
            entry, _ = search(self.v, graph, q, entry, 4)
        members, graph = self.layers[-1]
        entry = np.repeat(members[:1][None, :], len(q), axis=0) if entry is None else entry
        return search(self.v, graph, q, entry, beam)


@dataclass
class Found:
    """keys: ``query * rows + row`` of the links; dense: the queries whose links are not, or not all, among them and are
    read off by stripes; beam: the width that passed; near_found of near_all: nearest neighbours of the audit's sample
    that the walk met at that width."""

    keys: np.ndarray
    dense: np.ndarray
    beam: int
    near_found: int
    near_all: int


def _near(unit: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest similarity of each query, by brute force."""
    sim = q.astype(np.float32) @ unit.astype(np.float32).T
    return -np.partition(-sim, k - 1, axis=1)[:, k - 1]


def _pairs(index: Hnsw, unit: np.ndarray, q: np.ndarray, least: float, how: Graphs, rows: np.ndarray | None = None) -> Found:
    """The pairs of at least that cosine, at the first beam that passes an audit; with ``rows``, of those queries and of the
    audit's sample alone.

    ``unit`` and ``q``: rows of length one in double precision. A sample of the queries walks the graph
    alone, with wider and wider beams, until the audit passes; then every query walks it once. A
    query whose beam holds nothing but links may have more of them, and is searched again with a wider
    beam of its own; once that is a quarter of the shard, its links are read off by a scan. So is a
    shard whose audit fails even at a beam of all its nodes, which means that its graph falls apart.
    Queries that could have more than ``_LISTED`` links between them are left to ``_stripes``."""

    def scan(rows: np.ndarray) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            i, j = np.nonzero(q[part] @ unit.T >= loose)
            out.append(part[i] * n + j)
        return np.concatenate(out)

    def walk(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links of those of ``rows`` that are not dense, dense, similarities at the first width)."""
        keys, width, first, each = [], beam, None, n * len(every) // len(rows)
        dense = np.zeros(len(q), dtype=bool)
        while len(rows):
            node, sim = index.query(q[rows], width)
            first = sim[:, :k].copy() if first is None else first
            hit = (sim >= loose) & (node >= 0)
            a, b = np.nonzero(hit)
            keys.append(rows[a] * n + node[a, b])
            rows = rows[hit.all(1)] if width < n else rows[:0]
            if len(rows) * each > _LISTED:
                dense[rows] = True
                break
            width = 4 * width
            if len(rows) and 4 * width > n:
                keys.append(scan(rows))
                break
        found = np.unique(np.concatenate(keys))
        return found[~dense[found // n]], dense, first

    def whole(found: np.ndarray, dense: np.ndarray) -> bool:
        known = truth[~dense[truth // n]]
        return not len(known) or np.isin(known, found).mean() >= how.recall

    n = len(unit)
    loose = np.float32(least - 1e-4)
    sample = np.unique(np.linspace(0, len(q) - 1, min(how.audit, len(q))).astype(int))
    every = np.arange(len(q)) if rows is None else np.union1d(rows, sample)
    i, j = np.nonzero(q[sample] @ unit.T >= least)
    truth = sample[i] * n + j
    k = min(how.near, n)
    bound = _near(unit, q[sample], k) - 1e-5
    near_all = k * len(sample)
    beam = min(how.beam, n)
    while True:
        found, dense, first = walk(sample)
        near_found = int((first >= bound[:, None]).sum())
        good = near_found >= how.near_recall * near_all and whole(found, dense)
        if good and len(sample) < len(every):
            found, dense, _ = walk(every)
            good = whole(found, dense)
        if not good and beam >= n:
            near_found, good, dense = near_all, True, np.zeros(len(q), dtype=bool)
            if len(every) * n > _LISTED:
                found, dense[every] = found[:0], True
            else:
                found = np.unique(scan(every))
        if good:
            exact = [np.einsum("nd,nd->n", q[p // n], unit[p % n]) >= least for p in np.array_split(found, len(found) // 100_000 + 1)]
            return Found(found[np.concatenate(exact)], dense, beam, near_found, near_all)
        beam = min(beam + (beam + 1) // 2, n)


def _stripes(q: np.ndarray, unit: np.ndarray, rows: np.ndarray, least: float):
    """(some of ``rows``, which of them link to which rows of ``unit``): a stripe at a time, verified in double precision."""
    for at in range(0, len(rows), _STRIPE):
        part = rows[at : at + _STRIPE]
        cosine = q[part] @ unit.T
        hit = cosine >= least
        i, j = np.nonzero(np.abs(cosine - least) < 1e-9)  # decided as all other pairs are, whatever the order of sums
        hit[i, j] = np.einsum("nd,nd->n", q[part[i]], unit[j]) >= least
        yield part, hit


def _join(low: np.ndarray, me: int, others: np.ndarray) -> None:
    """``me`` and ``others`` get the least label of their groups in ``low``."""
    labels = low[others]
    first, last = min(low[me], labels.min()), max(low[me], labels.max())
    if first != last:
        low[np.isin(low, np.append(labels, low[me]))] = first


def _unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(how: Graphs):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        v = np.array(pdf["v"].to_list(), dtype=np.float64)
        index = Hnsw(_unit(v), how)
        with np.errstate(over="ignore"):
            short = v.astype(np.float32)  # half the bytes to move, where nothing is lost
        v = short if (short == v).all() else v
        layers = [(m.astype(np.int32), g.astype(np.int32)) for m, g in index.layers]
        unfound = (index.query(index.v, min(_SELF, len(v)))[0] != np.arange(len(v))[:, None]).all(1)
        blob = pickle.dumps((pdf["node"].to_numpy(), pdf["copies"].to_numpy(), v, layers, np.flatnonzero(unfound)), 5)
        return pd.DataFrame({"space": [pdf["space"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "graph": [blob]})

    return run


def _load(blob: bytes, how: Graphs):
    node, copies, v, layers, unfound = pickle.loads(blob)
    unit = _unit(v)
    index = Hnsw.__new__(Hnsw)
    index.v, index.how = unit.astype(np.float32), how
    index.layers = [(m.astype(np.int64), g.astype(np.int64)) for m, g in layers]
    return node, copies, unit, index, unfound


#: Rows of a tile: links of a node; a node and its root in the tile's forest (links 0); the audit of one search (node -1).
TILE = "node long, links long, root long, beam long, near_found long, near_all long"


def _tile(least: float, how: Graphs):
    """Two shards with each other, or one with itself. Every vector of the first walks the second's graph, which finds all
    links; the other way go those of the second that a walk towards themselves does not find, and the audit's sample."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        node_a, copies_a, unit_a, index_a, unfound_b = _load(left["graph"].iloc[0], how)
        same = int(left["a"].iloc[0]) == int(left["b"].iloc[0])
        node_b, copies_b, unit_b, index_b = node_a, copies_a, unit_a, index_a
        if not same:
            node_b, copies_b, unit_b, index_b, unfound_b = _load(right["graph"].iloc[0], how)
        n = len(node_b)
        searches = [_pairs(index_b, unit_b, unit_a, least, how)]
        i, j = searches[0].keys // n, searches[0].keys % n
        dense_a = searches[0].dense
        dense_b = dense_a
        if same:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        else:
            searches.append(_pairs(index_a, unit_a, unit_b, least, how, unfound_b))
            back, dense_b = searches[1].keys, searches[1].dense
            i, j = np.concatenate([i, back % len(node_a)]), np.concatenate([j, back // len(node_a)])
        keys = np.unique(i * n + j)
        i, j = keys // n, keys % n
        listed = ~dense_a[i] & ~dense_b[j]
        i, j = i[listed], j[listed]
        i, j = (i[i != j], j[i != j]) if same else (i, j)
        count_a = np.bincount(i, weights=copies_b[j], minlength=len(node_a)).astype(np.float64)
        count_b = count_a if same else np.bincount(j, weights=copies_a[i], minlength=n).astype(np.float64)
        # links of dense queries: counted, and joined to groups, stripe by stripe; rows of b come after those of a
        shift = 0 if same else len(node_a)
        low = np.arange(len(node_a) + (0 if same else n))
        for part, hit in _stripes(unit_a, unit_b, np.flatnonzero(dense_a), least):
            if same:
                hit[np.arange(len(part)), part] = False
            count_a[part] += hit @ copies_b.astype(np.float64)
            once = copies_a[part].astype(np.float64) @ hit
            count_b += np.where(dense_a, 0, once) if same else once
            for r, row in zip(part, hit, strict=True):
                if len(c := np.flatnonzero(row)):
                    _join(low, r, c + shift)
        if not same:
            for part, hit in _stripes(unit_b, unit_a, np.flatnonzero(dense_b), least):
                hit[:, dense_a] = False
                count_b[part] += hit @ copies_a.astype(np.float64)
                count_a += copies_b[part].astype(np.float64) @ hit
                for r, row in zip(part, hit, strict=True):
                    if len(c := np.flatnonzero(row)):
                        _join(low, r + shift, c)
        every = node_a if same else np.concatenate([node_a, node_b])
        moved = np.flatnonzero(low != np.arange(len(low)))
        tree = star_edges(np.concatenate([node_a[i], every[moved]]), np.concatenate([node_b[j], every[low[moved]]]))
        sides = [(node_a, count_a)] if same else [(node_a, count_a), (node_b, count_b)]
        none = {"beam": 0, "near_found": 0, "near_all": 0}
        out = [pd.DataFrame({"node": r[c > 0], "links": c[c > 0].astype(np.int64), "root": -1, **none}) for r, c in sides]
        out.append(pd.DataFrame({"node": tree[0], "links": 0, "root": tree[1], **none}))
        out += [pd.DataFrame({"node": [-1], "links": [0], "root": [-1], "beam": [x.beam], "near_found": [x.near_found], "near_all": [x.near_all]}) for x in searches]
        return pd.concat(out)[[c.split()[0] for c in TILE.split(", ")]].astype("int64")

    return run


def _usable(c: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    return F.coalesce(
        c.isNotNull()
        & (F.size(c) > 0)
        & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(c, lambda x: x != 0),
        F.lit(False),
    )


def search_all(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, how: Graphs | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, found): the rows with the key of their node, the nodes, and what the tiles of all
    shards found (``TILE``), each a scratch table."""
    how = how or Graphs()
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.when(F.col(f"`{label_col}`").isNotNull(), F.concat_ws(":", F.size(v).cast("string"), F.col(f"`{label_col}`").cast("string"))).alias("space"),
        v.alias("v"),
    )
    good = _usable(F.col("v")) & F.col("space").isNotNull() & F.col("_id").isNotNull()
    key = F.when(good, F.sha2(F.to_json(F.struct("space", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))), 256))
    named = save(rows.select("_id", "space", key.alias("key"), F.when(good, F.col("v")).alias("v")), "vectors")
    nodes = named.where("key is not null").groupBy("key").agg(F.min("_id").alias("least_id"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("v").alias("v"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written
    sizes = nodes.groupBy("space").agg(F.ceil(F.count("*") / how.shard_rows).cast("int").alias("shards"))
    n_shards, n_tiles = sizes.agg(F.sum("shards"), F.sum(F.expr("shards * (shards + 1L) div 2"))).first()
    spread = lambda df, n, *keys: df.repartition(min(_SPREAD * (n or 1), _PARTS), *keys).groupBy(*keys)
    dealt = nodes.join(sizes, "space").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    graphs = save(
        spread(dealt, n_shards, "space", "shard").applyInPandas(_build(how), "space string, shard int, shards int, graph binary"), "graphs"
    )
    left = graphs.select("space", F.col("shard").alias("a"), F.explode(F.expr("sequence(shard, shards - 1)")).alias("b"), "graph")
    right = graphs.select("space", F.explode(F.expr("sequence(0, shard)")).alias("a"), F.col("shard").alias("b"), "graph")
    tiles = spread(left, n_tiles, "space", "a", "b").cogroup(spread(right, n_tiles, "space", "a", "b"))
    found = save(tiles.applyInPandas(_tile(least, how), TILE), "links")
    drop(graphs)
    return named, nodes, found


def audit(found: DataFrame) -> DataFrame:
    """One row: searches of a shard by a shard's vectors, the widest beam, and the share of the nearest
    neighbours of their samples that they met (null without a search)."""
    return found.where("near_all > 0").agg(
        F.count("*").alias("searches"), F.max("beam").alias("widest_beam"), (F.sum("near_found") / F.sum("near_all")).alias("near_recall")
    )


def near_dedup(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    how: Graphs | None = None,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link at a cosine of at least ``least`` if their labels are equal and not null and
    their lengths are equal. Null and zero vectors, those with null or non-finite components,
    and rows with a null id or label link with nothing (0 links, own component, kept). Rows
    that repeat an id are vectors of their own, which only links bring together; equal rows link.
    No rows: no rows. Vectors of any length; a shard of them is in a task. Other columns are ignored.
    """
    named, nodes, found = search_all(df, id_col, vector_col, label_col, least, how)
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links = 0 and node >= 0").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    mine = nodes.select("key", "node", "least_id", "copies").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    smallest = mine.groupBy("part").agg(F.min("least_id").alias("component_id"))
    summary = (
        mine.join(smallest, "part")
        .join(links, "node", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    out = named.select("_id", "key").join(summary, "key", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
