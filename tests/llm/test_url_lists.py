from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from cytolake.llm import url_lists as U

T0 = datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def matches(url):
    if url is None:
        return set()
    bare = url.strip().lower().split("://", 1)[-1]
    bare = bare.split("?")[0].split("#")[0]
    host, _, path = bare.partition("/")
    host = host.split("@")[-1].split(":")[0].rstrip(".")
    if not host:
        return set()
    labels = host.split(".")
    segments = [s for s in path.split("/") if s]
    return {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(segments[: k + 1]) for k in range(len(segments))}


def brute(captures, entries):
    out = []
    for page, url, t in captures:
        state = {}
        for lst, pattern, action, when in sorted((e for e in set(entries) if None not in e and e[2] in ("add", "remove")), key=lambda e: (e[3], e[2])):
            if t is not None and when <= t:
                key = (lst, pattern.strip().lower())
                state[key] = when if action == "add" else None
        held = {k: w for k, w in state.items() if w is not None and k[1] in matches(url)}
        lists = sorted({k[0] for k in held})
        out.append((page, len(held) > 0, len(lists), ",".join(lists), max((k[1] for k in held), key=lambda p: (len(p), p), default=None), min(held.values(), default=None)))
    return sorted(out, key=str)


def test_against_replaying_the_history(spark):
    rng = np.random.default_rng(1)
    urls = ["https://a.example.com/x/y", "http://b.example.com:80/x?q=/z", "HTTPS://u@A.Example.com/x/#f", "example.com", "https://other.org/", None, "", "https:///nohost", "http://c.b.example.com./x/y/z", "  http://b.example.com/x "]
    patterns = ["example.com", "a.example.com", "b.example.com/x", "org", "A.example.com/x/y ", "b.example.com"]
    entries = [(f"l{rng.integers(3)}", patterns[rng.integers(len(patterns))], ["add", "remove", "note"][rng.integers(3)], at(int(rng.integers(0, 60)))) for _ in range(70)]
    entries += [("l0", "org", "add", at(30)), ("l0", "org", "remove", at(30)), ("l0", "org", "add", None), (None, "org", "add", at(1)), ("l1", None, "add", at(1)), ("l1", "org", None, at(1))] + entries[:9]
    captures = [(i, urls[i % len(urls)], at(int(rng.integers(0, 70)))) for i in range(120)]
    captures += [(3, urls[3], captures[3][2])] * 5 + [(None, urls[0], at(50)), (200, urls[0], None)]
    df = spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, fetched_at timestamp, blocked string").repartition(3)
    lists = spark.createDataFrame([(*e, 1) for e in entries], "list string, pattern string, action string, at timestamp, since int")
    got = [(r["page_id"], r["blocked"], r["n_lists"], r["lists"], r["matched"], r["since"]) for r in U.judge(df, lists).collect()]
    assert sorted(got, key=str) == brute(captures, entries)
    assert any(r[1] for r in got) and not all(r[1] for r in got)
    assert U.judge(df.limit(0), lists).count() == 0
    assert U.judge(df, lists.limit(0)).where("blocked").count() == 0


def test_intervals_do_not_overlap(spark):
    rows = [("l", "p", a, at(h)) for a, h in (("add", 1), ("add", 5), ("remove", 9), ("add", 9), ("remove", 12), ("add", 20))]
    got = U.intervals(spark.createDataFrame(rows, "list string, pattern string, action string, at timestamp")).orderBy("since").collect()
    assert [(r["since"], r["until"]) for r in got] == [(at(1), at(5)), (at(5), at(9)), (at(20), None)]


def test_keys(spark):
    url = "http://User@A.b.com:8080/p//q/?x=/y"
    got = spark.range(1).select(U.keys(F.lit(url))).first()[0]
    assert sorted(got) == sorted({"a.b.com", "b.com", "com", "a.b.com/p", "a.b.com/p/q"})
