"""Trees whose calls are resolved in slices."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom import durable
from graphloom.plans import code_tree
from graphloom.sources import index as ix
from graphloom.sources.parse import parse

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    return durable.durable(parse(code_tree.sources(spark, SMALL)), "facts")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_slices_of_a_tree_give_the_graph_of_the_whole(spark, facts, monkeypatch):
    whole = ix.build(facts)
    sites = facts.agg(F.sum(F.size("refs"))).first()[0]
    monkeypatch.setattr(ix, "SLICE_SITES", sites // 3)
    assert len(ix._slices(facts)) > 2
    cut = ix.build(facts)
    for name in ix.CodeGraph.TABLES:
        assert rows(getattr(cut, name)) == rows(getattr(whole, name)), name


def test_no_more_sites_are_shuffled_at_once_than_a_slice_has(spark, facts, monkeypatch):
    """Calls are written slice by slice, each with no more sites than its share, and none is lost."""
    sites = facts.agg(F.sum(F.size("refs"))).first()[0]
    monkeypatch.setattr(ix, "SLICE_SITES", sites // 4)
    written, real = [], ix.durable

    def counted(df, name):
        stored = real(df, name)
        if name == "calls":
            written.append(stored.count())
        return stored

    monkeypatch.setattr(ix, "durable", counted)
    ix.build(facts)
    assert sum(written) == sites and len(written) > 3 and max(written) < sites / 2


def test_sources_made_in_parts_are_those_of_the_whole_and_no_part_holds_all(spark, monkeypatch):
    """Line items and texts of a large tree go round part by part; nothing but the files stays written."""
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(ix, "SLICE_SITES", items // 4)
    monkeypatch.setattr(code_tree, "PARTS_PER_FILE", 20)
    whole = rows(code_tree._texts(code_tree.functions(spark, SMALL), code_tree.callee_names(spark, SMALL, code_tree.pairs(spark, SMALL))))
    made, real = {}, durable.durable

    def counted(df, name):
        stored = real(df, name)
        made.setdefault(name, []).append((stored, stored.count()))
        return stored

    monkeypatch.setattr(durable, "durable", counted)
    files = code_tree.sources(spark, SMALL)
    assert rows(files) == whole
    for name in ("tree-pairs", "tree-files"):
        sizes = [n for _, n in made[name]]
        assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes), name
    assert not any(durable.written(t) for t, _ in made["tree-pairs"]) and durable.written(files)


def test_call_sites_and_symbols_do_not_stay_once_the_graph_is_made(spark, facts, monkeypatch):
    made, real = {}, ix.durable

    def kept(df, name):
        made.setdefault(name, []).append(real(df, name))
        return made[name][-1]

    monkeypatch.setattr(ix, "durable", kept)
    graph = ix.build(facts)
    assert not any(durable.written(t) for name in ("calls", "seen", "symbols") for t in made[name])
    assert all(durable.written(t) for t in (graph.edges, graph.nodes, graph.imports, graph.unbound))
    assert graph.counters.first()["ambiguous"] == graph.unbound.count()


def test_files_of_a_tree_are_made_without_its_graph(spark, monkeypatch):
    monkeypatch.setattr(code_tree, "_FILES", {})
    monkeypatch.setattr(code_tree, "built", None)
    assert code_tree.tree_patterns(spark, SMALL).count() > 0


def test_a_sweep_leaves_no_shuffle_files_of_the_last_table_written(spark):
    """Spark deletes them in the background, so they are looked for until they are gone."""
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = shuffled()
    for _ in range(3):
        stored = durable.durable(spark.range(1000).repartition(3, "id").withColumn("n", F.col("id") % 7), "swept")
        made = shuffled() - before
        assert made
        durable.sweep(spark)
        until = time.monotonic() + 5
        while made & shuffled() and time.monotonic() < until:
            time.sleep(0.1)
        assert not made & shuffled()
        durable.discard(stored)


def test_blocks_are_dealt_to_parts_evenly(spark, monkeypatch):
    monkeypatch.setattr(ix, "MOST_SLICES", 4)
    blocks = spark.range(13).selectExpr("id - 1 k")
    sizes = [blocks.filter(within(F.col("k"))).count() for within in ix.parted(10 * ix.SLICE_SITES, lambda c: c)]
    assert sum(sizes) == 13 and max(sizes) - min(sizes) <= 1
