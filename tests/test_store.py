"""Stored graphs: lookups, versions, reach by lookup, and strong components of long paths."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import durable as d
from graphloom.operators import graph
from graphloom.sources import store

EDGE = "src string, dst string, kind string, conf double, lines array<int>"


def edges(spark, n=3000, seed=1):
    rng = random.Random(seed)
    pick = lambda: f"f:{int(rng.random() ** 3 * 400)}"
    return spark.createDataFrame([(pick(), pick(), rng.choice(["calls", "imports"]), 1.0, None) for _ in range(n)], EDGE).distinct()


def test_lookup_opens_the_bucket_of_its_id_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_EDGES", 100)
    every = edges(spark)
    store.Lookup.write(every, str(tmp_path))
    kept = store.Lookup.read(spark, str(tmp_path))
    assert kept.buckets > 8
    for end in ("src", "dst"):
        for ids in (["f:0"], ["f:7", "f:300"], ["nothing"]):
            near = kept.near(end, ids)
            assert sorted(map(str, near.collect())) == sorted(map(str, every.filter(F.col(end).isin(ids)).collect()))
            scan = near._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
            assert scan.apply("numPartitions").value() <= len(ids) and scan.apply("numFiles").value() <= len(ids)
            plan = near._jdf.queryExecution().executedPlan().toString()
            assert f"PushedFilters: [In({end}" in plan or f"EqualTo({end}" in plan
    # sorted by its end inside a bucket
    one = spark.read.parquet(f"{tmp_path}/edges_in").filter("bucket = 0").select("dst").collect()
    assert [r.dst for r in one] == sorted(r.dst for r in one)


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    where = str(tmp_path / "g")
    assert store.current(spark, where) is None
    number = lambda n: lambda folder: spark.range(n).write.parquet(f"{folder}/t")
    first = store.publish(spark, where, number(1))
    pinned = spark.read.parquet(f"{store.current(spark, where)}/t")

    def breaks(folder):
        number(2)(folder)
        raise OSError("midway")

    with pytest.raises(OSError):
        store.publish(spark, where, breaks)
    assert store.current(spark, where) == first and pinned.count() == 1
    third = store.publish(spark, where, number(3))
    assert third.endswith("v-3") and store.current(spark, where) == third and pinned.count() == 1
    assert [n for n, _ in store.versions(spark, where)] == [1, 3]
    store.publish(spark, where, number(4))
    assert [n for n, _ in store.versions(spark, where)] == [3, 4]


def plain_reach(rows, seeds, depth, direction, cap):
    hops, front, capped = dict.fromkeys(seeds, 0), set(seeds), False
    for hop in range(1, depth + 1):
        new = {b for a, b in rows if a in front} if direction != "in" else set()
        new |= {a for a, b in rows if b in front} if direction != "out" else set()
        front = sorted(new - hops.keys())
        if cap is not None and len(hops) + len(front) > cap:
            front, capped = front[: cap - len(hops)], True
        hops |= dict.fromkeys(front, hop)
        if capped or not front:
            break
        front = set(front)
    return sorted((i, h, capped) for i, h in hops.items())


@pytest.mark.parametrize(("direction", "depth", "cap"), [("out", 1, 20_000), ("in", 3, 20_000), ("both", 2, 60), ("out", 4, None)])
def test_reach_by_lookup_and_by_scan(spark, tmp_path, monkeypatch, direction, depth, cap):
    monkeypatch.setattr(store, "BUCKET_EDGES", 500)
    monkeypatch.setattr(graph, "FEW", 5)
    every = edges(spark, 900)
    store.Lookup.write(every, str(tmp_path))
    kept = store.Lookup.read(spark, str(tmp_path))
    want = plain_reach([(r.src, r.dst) for r in every.collect()], ["f:390", "f:3"], depth, direction, cap)
    seeds = spark.createDataFrame([("f:390",), ("f:3",), ("f:3",)], "id string")
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, name="t": written.append(name) or d.durable(df, name))
    for near in (None, kept.near):
        assert sorted(map(tuple, graph.reach(kept.out, seeds, depth, direction, cap, near).collect())) == want
    assert "hops" not in written and (cap is None or not written)


def strong(rows):
    ahead = {}
    for a, b in rows:
        ahead.setdefault(a, set()).add(b)

    def seen(i):
        out, front = set(), [i]
        while front:
            for b in ahead.get(front.pop(), ()):
                if b not in out:
                    out.add(b)
                    front.append(b)
        return out

    far = {i: seen(i) for i in {x for r in rows for x in r}}
    groups = {i: {j for j in far[i] if i in far[j]} for i in far if i in far[i]}
    return sorted((i, min(g), len(g)) for i, g in groups.items() if len(g) > 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_of_mixed_graphs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("r4", "c0"), ("c12", "r0")] * (seed % 2)
    rows += [("a", "b"), ("b", "a"), ("b", "x"), ("x", "b"), ("s", "s"), ("x", "y"), ("y", "z")]
    rows += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]
    found = graph.strong_components(spark.createDataFrame(rows, "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == strong([r for r in rows if r[0] != r[1]])


def test_a_ring_and_a_chain_of_ten_thousand_take_few_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, name="t": written.append(name) or d.durable(df, name))
    steps = spark.range(10_000)
    ring = steps.selectExpr("concat('r', id) src", "concat('r', (id + 1) % 10000) dst")
    chain = steps.selectExpr("concat('c', id) src", "concat('c', id + 1) dst")
    found = graph.strong_components(ring.union(chain)).groupBy("component", "size").count().collect()
    assert [tuple(r) for r in found] == [("r0", 10_000, 10_000)]
    assert len(written) < 150, len(written)
