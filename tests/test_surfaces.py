"""Command line, JSON-RPC, scorecard, layout and streams."""

import io
import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from graphloom import cli, serve
from graphloom.operators import graph, layout, metrics, search
from graphloom.sources import index as ix
from graphloom.streaming import incremental

TREE = {"README.md": "# r\n", "app/main.py": "from app.lib import plus\n\n\ndef main():\n    return plus(1)\n", "app/lib.py": "def plus(x):\n    return x\n\n\nclass Big:\n    def go(self):\n        return plus(2)\n"}


def tree(root):
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_server_and_index_on_disk(spark, tmp_path):
    server = cli.Server(spark, tree(tmp_path))
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate([("initialize", {}), ("ping", {}), ("tools/list", {}), ("tools/call", {"name": "who-calls", "arguments": {"target": "plus", "budget": 0}}), ("nope", {}), ("tools/call", {})])]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join([*lines, "{broken", "[]"]) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got[2]["result"]["tools"]) == 14
    assert "2 callers" in got[3]["result"]["content"][0]["text"]
    assert [g["error"]["code"] for g in got[4:]] == [-32601, -32602, -32700, -32600]
    assert cli.locate(str(tmp_path / "app")) == tmp_path / cli.HOME
    again = cli.build(spark, str(tmp_path))
    assert again.nodes.filter("kind = 'Function'").count() == 3
    assert "main" in cli.ask(again, str(tmp_path), "span", ["app/main.py:main"]).text()
    made = cli.report(again, 50, str(tmp_path))
    nodes = {n["id"]: n for n in made["graph"]["nodes"]}
    assert 0 <= made["scores"]["overall"] <= 100 and made["scores"]["grade"] and nodes.keys() >= {"f:app/main.py", "f:app/lib.py"}
    assert made["scores"]["metrics"]["navigability"]["factors"]["entry_points"] == 60 and made["stats"]["functions"] == 3
    assert len({(n["ax"], n["ay"]) for n in nodes.values()}) == len(nodes)
    assert nodes == {n["id"]: n for n in cli.report(again, 50, str(tmp_path))["graph"]["nodes"]}


def test_clouds_in_space(spark):
    nodes = [("d:.", "Module", "."), ("d:a", "Module", "a"), ("d:b", "Module", "b"), *[(f"f:a/{i}", "File", f"a/{i}") for i in range(30)], ("f:b/x", "File", "b/x"), *[(f"s:a/1#{i}", "Function", "a/1") for i in range(20)], ("lib:used", "Library", None), ("lib:lone", "Library", None)]
    edges = [("f:a/1", "f:b/x", "imports"), ("f:a/1", "lib:used", "imports"), ("f:b/x", "lib:used", "imports")]
    placed = layout.nebula(spark.createDataFrame(nodes, "id string, kind string, path string"), spark.createDataFrame(edges, "src string, dst string, kind string")).collect()
    at = {r.id: (r.x, r.y, r.z) for r in placed}
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5
    assert len(at) == len(nodes) and len(set(at.values())) > len(nodes) - 3
    assert at["f:b/x"] == at["d:b"]
    assert all(far(at[f"f:a/{i}"], at["d:a"]) < 2.5 * (12 + 4.6 * 30**0.5) for i in range(30))
    assert all(far(at[f"s:a/1#{i}"], at["f:a/1"]) < 2.5 * (5 + 2.6 * 20**0.5) for i in range(20))
    mean = [(x + y) / 2 * 1.25 for x, y in zip(at["f:a/1"], at["f:b/x"], strict=True)]
    assert far(at["lib:used"], mean) < 8 * 3**0.5 + 0.1 and abs(far(at["lib:lone"], (0, 0, 0)) - 190) < 0.1


def test_served_map(tmp_path, monkeypatch):
    root = tree(tmp_path / "project")
    folder = serve.write_report({"meta": {"name": "x"}}, str(tmp_path / "report"))
    launched = []
    monkeypatch.setattr(serve, "editor", lambda: "code")
    monkeypatch.setattr(serve.Handler, "launch", staticmethod(lambda *command: launched.append(command) or {"ok": True}))
    with serve.bind(str(folder), root) as server, serve.bind(str(folder), None) as other:
        for s in (server, other):
            threading.Thread(target=s.serve_forever, daemon=True).start()

        def get(path, s=server):
            try:
                with urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}{path}", timeout=10) as answer:
                    return answer.status, answer.read().decode()
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode()

        assert server.server_address[0] == "127.0.0.1" and server.server_address[1] != other.server_address[1]
        assert json.loads(get("/data.json")[1]) == {"meta": {"name": "x"}} and "canvas" in get("/index.html")[1]
        assert json.loads(get("/api/vscode-status")[1]) == {"available": True, "root": os.path.realpath(root)}
        assert json.loads(get("/api/open?path=app/main.py&line=3")[1])["ok"] and json.loads(get("/api/open?path=app/main.py&line=3;rm")[1])["ok"]
        assert [c[2].rpartition(":")[2] for c in launched] == ["3", "1"]
        for bad in ("../report/data.json", "/etc/passwd", "nothing.py", ""):
            assert not json.loads(get(f"/api/open?path={bad}")[1])["ok"]
        assert json.loads(get("/api/open-project")[1])["ok"] and not json.loads(get("/api/open-project", other)[1])["ok"]
        assert get("/api/else")[0] == 404 and len(launched) == 3
        monkeypatch.setattr(serve, "editor", lambda: None)
        assert not json.loads(get("/api/open?path=app/main.py")[1])["ok"]
        server.shutdown()
        other.shutdown()


def test_statistics(spark, tmp_path):
    g, _ = ix.index(spark, tree(tmp_path))
    s = metrics.statistics(g)
    assert (s["files"], s["functions"], s["docs"], s["cycles"], s["links"]) == (2, 3, 1, 0, 1)
    card = metrics.scorecard(s)
    assert set(card["metrics"]) == {"navigability", "context_efficiency", "modularity", "complexity", "self_description"}
    assert card["metrics"]["navigability"]["factors"]["entry_points"] == 60
    assert metrics.scorecard(s | {"readme": False, "functions": 0})["metrics"]["complexity"] == {"score": 100.0, "factors": {"nesting": 100.0}, "notes": ["no functions were found; nesting alone is scored"]}
    assert metrics.statistics(g, ["Readme", "Main.py"])["entry"] and not metrics.statistics(g, ["index.html"])["readme"]
    assert metrics.scorecard(dict.fromkeys(s, 0))["metrics"]["navigability"]["score"] == 0
    assert metrics._band(0.5, 1, 12, 0, 45) == 50 and metrics._le(450, 200, 700) == 50 and metrics._ge(0.4, 0.1, 0.7) > 49.9


def test_layout_is_deterministic():
    sizes = [(f"m{i}", float(1 + i % 4)) for i in range(20)]
    at, side = layout.shelves(sizes), dict(sizes)
    assert at == layout.shelves(sizes[::-1])
    boxes = [(x, y, side[m]) for m, (x, y) in at.items()]
    assert not any(a is not b and a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[2] and b[1] < a[1] + a[2] for a in boxes for b in boxes)
    links = [("a", "b", 3.0), ("b", "c", 1.0)]
    assert layout.force(["a", "b", "c"], links) == layout.force(["a", "b", "c"], links)


def test_strong_components_of_a_chain_of_cycles_and_the_visited_cap(spark):
    # cycles of two in a chain, in label order: once each of them needed a round
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 40, 2)]
    links = [*pairs, *[(b, a) for a, b in pairs], *[(pairs[i][1], pairs[i + 1][0]) for i in range(19)], ("x", "n000"), ("n039", "y")]
    found = graph.strong_components(spark.createDataFrame(links, "src string, dst string")).collect()
    assert {(r.id, r.component, r["size"]) for r in found} == {(n, a, 2) for a, b in pairs for n in (a, b)}
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 20}") for i in range(20)], "src string, dst string")
    assert {r["size"] for r in graph.strong_components(ring).collect()} == {20}
    seeds = spark.createDataFrame([("r0",)], "id string")
    capped = graph.reach(ring, seeds, 12, "out", cap=5).collect()
    assert len(capped) == 5 and all(r.capped for r in capped) and {r.hop for r in capped} == set(range(5))
    assert not any(r.capped for r in graph.reach(ring, seeds, 4, "out", cap=5).collect())


def test_best_hit(spark):
    nodes = spark.createDataFrame([("f:a", "File", "Main.py", "src/Main.py", 3), ("s:b", "Function", "domain", None, 9), ("s:c", "Class", "Remain", "src/x.py", 9)], "id string, kind string, name string, path string, degree int")
    assert search.best_hit(nodes, " MAIN ").first().id == "s:b"
    assert search.best_hit(nodes, "main", ("Function", "Class")).first().id == "f:a"
    assert search.best_hit(nodes, "  ").count() == search.best_hit(nodes, "nowhere").count() == 0


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, content string").write.parquet(str(src / "0"))
    schema = spark.read.parquet(str(src / "0")).schema
    for turn in range(2):
        incremental.keep_current(incremental.read_stream(spark, str(src / "*"), schema), out, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("a", "2"), ("c", "1"), ("b", "1")], "path string, content string").write.mode("overwrite").parquet(str(src / "1"))
    assert {(r.path, r.content) for r in incremental.current(spark, out).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    # what has not changed is stored once
    assert spark.read.parquet(out).count() == 4
    assert incremental.compact(spark, out) == 1 and spark.read.parquet(out).count() == 3
    assert {(r.path, r.content) for r in incremental.current(spark, out).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    spark.createDataFrame([("k", f"x{i}", i) for i in range(6)], "path string, content string, seq int").write.parquet(str(tmp_path / "ordered"))
    ordered = lambda name, **o: incremental.keep_current(incremental.read_stream(spark, str(tmp_path / "ordered"), spark.read.parquet(str(tmp_path / "ordered")).schema), str(tmp_path / name), str(tmp_path / f"cp-{name}"), **o)
    ordered("by-seq", order="seq").awaitTermination()
    assert incremental.current(spark, str(tmp_path / "by-seq")).first().content == "x5"
    with pytest.raises(Exception, match="two contents"):
        ordered("unordered").awaitTermination()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {tuple(r) for r in incremental.event_windows(events).select("start", "event_type", "n").collect()}
    events.write.parquet(str(tmp_path / "events"))
    stream = incremental.event_windows(incremental.read_stream(spark, str(tmp_path / "events"), events.schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("event_windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("select start, event_type, n from event_windows").collect()} == batch
