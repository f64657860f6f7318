"""Nothing is left out of a long list: call sites of a symbol, callees, dependents, candidates."""

import graphloom.sources.parse as reader
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import durable
from graphloom.operators import commands, graph
from graphloom.plans import code_tree
from graphloom.sources import index as ix
from graphloom.sources import java_frontend

from graphloom.sources.parse import compiled_java, facts, parse

MANY = 700


def tree(spark, texts):
    return spark.createDataFrame([(p, "python", "code", bytearray(t.encode())) for p, t in texts.items()], "path string, lang string, kind string, content binary")


@pytest.mark.parametrize("frontends", [True, False])
def test_every_call_site_of_a_symbol_is_read(frontends):
    text = "def all_():\n" + "".join(f"    helper_{i}()\n" for i in range(MANY)) + "    return 1\n\n"
    refs = facts("a.py", "python", "code", text.encode(), frontends)["refs"]
    assert [r["name"] for r in refs] == [f"helper_{i}" for i in range(MANY)]


def test_every_call_that_the_compiler_tells_is_kept():
    symbol = {"name": "all", "kind": "Function", "line": 1, "length": MANY, "parent": None, "documented": False}
    calls = [{"owner": 0, "name": f"f{i}", "is_method": False, "recv": None, "line": i + 1, "cands": [], "tag": "at", "tpath": "B.java", "tline": i} for i in range(MANY)]
    assert len(compiled_java({"symbols": [symbol], "calls": calls, "imports": []}, [""] * MANY)["refs"]) == MANY


def test_all_callees_and_all_dependents_are_listed(spark, monkeypatch):
    monkeypatch.setattr(graph, "VISITED_CAP", 20)
    texts = {f"lib/m{i}.py": f"import os\n\ndef helper_{i}():\n    return {i}\n" for i in range(MANY)}
    g = ix.build(parse(tree(spark, texts | {"top.py": "def all_():\n" + "".join(f"    helper_{i}()\n" for i in range(MANY))})))
    a = commands.run(g, "calls", target="all_", limit=None)
    assert a.values["total"] == a.tables["callees"].select("id").distinct().count() == MANY
    assert a.lines[0] == f"all_ calls ({commands.NEIGHBOURS} of {MANY})" and len(a.lines) == commands.NEIGHBOURS + 1
    a = commands.run(g, "dependents", target="lib:os", limit=None)
    assert a.values["total"] == a.tables["deps"].select("id").distinct().count() == MANY and not a.values["capped"]
    assert commands.run(g, "calls", target="all_").tables["callees"].count() == commands.NEIGHBOURS


def test_an_entry_point_is_found_whatever_it_depends_on(spark):
    """A launcher without imports or a main function stands behind any number of files that have more."""
    code = spark.range(5000).select(F.concat(F.lit("f:m"), "id").alias("id"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit(3).alias("outdeg"))
    code = code.union(spark.createDataFrame([("f:zz/server.py", "zz/server.py", 0)], code.schema))
    none = spark.createDataFrame([], "path string"), spark.createDataFrame([], "src string, dst string, kind string")
    first = commands.entry_points(code, *none).first()
    assert (first["path"], first["why"], first["score"]) == ("zz/server.py", "named", 50)


def test_what_asks_for_no_calls_resolves_none_and_finds_the_same(spark, monkeypatch):
    """Files, symbols, imports and degrees of files do not wait for the calls of functions; a call outside of them still counts."""
    text = "import lib.a\nfrom lib.b import two\n\ntwo()\n\ndef one():\n    two()\n    three()\n"
    read = parse(tree(spark, {"lib/a.py": "def three():\n    return 3\n", "lib/b.py": "def two():\n    return 2\n", "top.py": text}))
    whole = ix.build(read)
    resolved, real = [], ix.call_sites

    def counted(*args):
        resolved.append(real(*args))
        return resolved[-1]

    monkeypatch.setattr(ix, "call_sites", counted)
    monkeypatch.setattr(ix, "discard", lambda *tables: None)
    part = ix.build(ix.outside(read))
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert sum(t.count() for t in resolved) == 1
    for name in ("imports", "files"):
        assert rows(getattr(part, name).drop("refs")) == rows(getattr(whole, name).drop("refs"))
    assert rows(part.nodes.filter("kind <> 'Function'")) == rows(whole.nodes.filter("kind <> 'Function'"))
    assert rows(part.nodes.drop("indeg", "outdeg")) == rows(whole.nodes.drop("indeg", "outdeg"))
    assert rows(part.edges.filter("kind <> 'calls' or src like 'f:%'")) == rows(whole.edges.filter("kind <> 'calls' or src like 'f:%'"))
    resolved.clear()
    bare = ix.build(ix.outside(read.filter("path <> 'top.py'")))
    assert not resolved and bare.counters.first()["bound"] == 0 and bare.edges.filter("kind = 'calls'").isEmpty()


def test_imports_are_resolved_once_for_a_folder_and_language(spark):
    """A file never resolves to itself, though what an import may mean is looked up for its whole folder."""
    from graphloom.operators import imports as rules

    files = spark.createDataFrame([("a/x.py", "python"), ("a/y.py", "python"), ("a/x.js", "javascript"), ("b/x.py", "python"), ("c/only.py", "python")], "path string, lang string")
    asked = files.select("path", F.explode(F.array(*map(F.lit, ("x", ".x", "only", "a.x", "./y")))).alias("raw"))
    got = {(r.path, r.raw): r.resolved for r in rules.resolve(asked.union(asked), files).collect()}
    assert len(got) == 25
    assert got["a/y.py", "x"] == "a/x.py" and got["a/x.py", "x"] == "b/x.py" and got["a/x.js", "x"] is None
    assert got["c/only.py", "x"] is None and got["a/x.py", "only"] == "c/only.py" and got["c/only.py", "only"] is None
    assert got["a/x.py", ".x"] is None and got["a/y.py", ".x"] == "a/x.py" and got["b/x.py", "a.x"] == "a/x.py"
    assert {(r.path, r.raw): r.resolved for r in rules.resolve(asked.join(files, "path"), files).collect()} == got


CLASS = "public class A { int one() { return two(); } int two() { return 2; } }\n"


def test_a_compiler_that_fails_raises_and_a_file_it_cannot_read_is_told(spark, monkeypatch):
    if not java_frontend.available():
        pytest.skip("no Java compiler")
    assert java_frontend.read([("A.java", CLASS), ("B.java", "class {")], []).keys() == {"A.java"}
    java = lambda text: facts("A.java", "java", "code", text.encode(), True, java_frontend.read([("A.java", text)], []).get("A.java"))["frontend"]
    assert java(CLASS) == "javac" and java("class {") == "regex"
    for heap, seconds in (("2m", 3600), ("1g", 0.01)):
        with monkeypatch.context() as m:
            m.setattr(java_frontend, "HEAP", heap)
            m.setattr(java_frontend, "SECONDS", seconds)
            with pytest.raises(java_frontend.CompilerFailed):
                java_frontend.read([("A.java", CLASS)], [])


def test_what_the_compiler_tells_is_whole(monkeypatch, tmp_path):
    """A process that ends well but before its last line has failed as well."""
    if not java_frontend.available():
        pytest.skip("no Java compiler")
    helper = tmp_path / "Early.java"
    helper.write_text('public class Early { public static void main(String[] none) { System.out.println("F\\tA.java"); } }')
    monkeypatch.setattr(java_frontend, "HELPER", helper)
    with pytest.raises(java_frontend.CompilerFailed):
        java_frontend.read([("A.java", CLASS)], [])


def test_java_calls_are_no_result_where_the_compiler_has_not_read_a_file(spark, monkeypatch):
    monkeypatch.setattr(code_tree, "parse", lambda files: parse(files, frontends=False))
    with pytest.raises(RuntimeError, match="has not read 25 files"):
        code_tree.tree_java(spark, "/root/testdata/sf0.001")


def test_facts_of_few_files_are_held_at_once(spark, monkeypatch):
    """An Arrow batch of many files is read in portions; a long file is one, and empty batches and files are none."""
    sizes = [300, 300, 300, 2000, 0, 10, 990, 5]
    batch = pa.RecordBatch.from_pylist([{"path": str(i), "content": b"x" * n} for i, n in enumerate(sizes)])
    monkeypatch.setattr(reader, "PORTION_BYTES", 1000)
    held = [[len(c) for c in few["content"].to_pylist()] for few in reader._portions(batch)]
    assert held == [[300, 300, 300], [2000], [0, 10, 990], [5]]
    assert list(reader._portions(batch.slice(0, 0))) == []


def test_patterns_read_each_file_once(spark, monkeypatch):
    """What the patterns read is written before it is asked for symbols and for calls, without the bodies."""
    made, real = [], durable.durable

    def kept(df, name):
        made.append((name, real(df, name)))
        return made[-1][1]

    monkeypatch.setattr(durable, "durable", kept)
    found = code_tree.tree_patterns(spark, "/root/testdata/sf0.001")
    read = dict(made)["tree-patterns"]
    assert "body" not in read.schema["symbols"].dataType.elementType.names
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0
