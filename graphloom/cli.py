"""Command line and JSON-RPC surface: index a tree, ask it, score it, serve it to a client.

    python -m graphloom.cli index ROOT [--out DIR] [--force] [--all] [--regex] [--json]
    python -m graphloom.cli q COMMAND [TARGET...] [--index DIR] [--depth N] [--kinds K] [--budget N] [--json]
    python -m graphloom.cli map ROOT [--out DIR] [--port N] [--max-nodes N] [--view V] [--no-open] [--build-only] [--all] [--json]
    python -m graphloom.cli mcp ROOT
"""

from __future__ import annotations

import argparse
import contextlib
import inspect
import json
import os
import sys
import time
import webbrowser
from pathlib import Path
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom import serve
from graphloom.operators import commands, layout, metrics
from graphloom.session import local_session
from graphloom.sources import store
from graphloom.sources.index import CodeGraph, index
from graphloom.sources.parse import FRONTENDS

HOME = ".graphloom"


def locate(start: str) -> Path:
    """The nearest index at or above a folder."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if any((folder / HOME).glob(f"{store.VERSION}*/{store.DONE}")):
            return folder / HOME
    raise FileNotFoundError(f"no index at or above {start}; run index first")


def build(spark: SparkSession, root: str, out: str | None = None, force: bool = False, everything: bool = False, frontends: bool | tuple[str, ...] = True) -> CodeGraph:
    """Index a tree, reusing the stored facts of unchanged files, and store it."""
    where = Path(out or Path(root) / HOME)
    before = store.current(spark, str(where))
    cached = spark.read.parquet(f"{before}/facts") if before and not force else None
    graph, now = index(spark, root, not everything, frontends, cached)
    graph.write(str(where), now)
    return CodeGraph.read(spark, str(where))


def ask(graph: CodeGraph, root: str, command: str, targets: list[str], **options) -> commands.Answer:
    """Run a command with the options that it has."""
    if command not in commands.COMMANDS:
        raise ValueError(f"unknown command {command!r}; there are {', '.join(commands.COMMANDS)}")
    wanted = inspect.signature(commands.COMMANDS[command]).parameters
    given = {k: v for k, v in options.items() if k in wanted and v is not None}
    if "seeds" in wanted:
        given["seeds"] = targets
    elif "target" in wanted:
        if not targets:
            raise ValueError(f"{command} needs a target")
        given["target"] = targets[0]
    if "source" in wanted:
        given["source"] = lambda path: (Path(root) / path).read_bytes()
    return commands.run(graph, command, **given)


def report(graph: CodeGraph, limit: int, root: str | None = None, view: str = "nebula") -> dict:
    """meta, stats, scores and the drawing of at most so many nodes, as plain data.

    Nodes have a place in space (x, y, z) and on the flat atlas (ax, ay).
    """
    nodes, edges = metrics.drawing(graph, limit)
    flat = layout.atlas(nodes.withColumn("module", F.coalesce(F.regexp_extract("path", "^([^/]*)/", 1), F.lit("")))).select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    count = lambda df, by: {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).collect()}
    code = graph.files.filter("kind = 'code'")
    kinds, edge_kinds = count(graph.nodes, "kind"), count(graph.edges, "kind")
    stats = {"files": graph.files.count(), "code_files": code.count(), "total_loc": code.agg(F.coalesce(F.sum("loc"), F.lit(0))).first()[0], "functions": kinds.get("Function", 0), "classes": kinds.get("Class", 0), "languages": count(code, "lang"), "node_kinds": kinds, "edge_kinds": edge_kinds, "total_nodes": sum(kinds.values()), "total_edges": sum(edge_kinds.values())}
    meta = {"root": os.path.abspath(root) if root else None, "name": os.path.basename(os.path.abspath(root)) if root else "", "generated": time.strftime("%Y-%m-%d %H:%M:%S"), "view": view}
    drawn = {"nodes": rows(layout.nebula(nodes, edges).join(flat, "id")), "edges": rows(edges.select("src", "dst", "kind", "conf"))}
    return {"meta": meta, "stats": stats, "scores": metrics.readiness(graph, os.listdir(root) if root else None), "graph": drawn}


def show(folder: Path, root: str, port: int, browse: bool) -> None:
    """Serve a report until it is interrupted."""
    with serve.bind(str(folder), root, port) as server:
        url = f"http://127.0.0.1:{server.server_address[1]}/"
        print(f"map at {url}", file=sys.stderr)
        if browse:
            webbrowser.open(url)
        with contextlib.suppress(KeyboardInterrupt):
            server.serve_forever()


def _tool(name: str) -> dict:
    kinds = {"int": "integer", "int | None": "integer", "bool": "boolean", "str": "string", "str | None": "string", "list[str]": "array"}
    props = {p.name: {"type": kinds.get(str(p.annotation), "string")} | ({"items": {"type": "string"}} if p.annotation == "list[str]" else {}) for p in list(inspect.signature(commands.COMMANDS[name]).parameters.values())[1:] if p.name != "source"}
    return {"name": name, "description": (commands.COMMANDS[name].__doc__ or f"The {name} of the indexed tree").strip().split("\n")[0], "inputSchema": {"type": "object", "properties": props | {"budget": {"type": "integer"}}}}


class Server:
    """JSON-RPC over lines: initialize, ping, tools/list and tools/call."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.graph = spark, root, None

    def handle(self, request: object) -> dict | list | None:
        if isinstance(request, list):
            return [a for a in map(self.handle, request) if a] or self._error(None, -32600, "empty batch")
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, -32600, "invalid request")
        if "id" not in request:
            return None
        method, params = request["method"], request.get("params") or {}
        try:
            if method == "initialize":
                result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": [{"name": "index", "description": "Index the tree again", "inputSchema": {"type": "object", "properties": {}}}, *map(_tool, commands.COMMANDS)]}
            elif method == "tools/call":
                result = self._call(params)
            else:
                return self._error(request["id"], -32601, f"no method {method}")
        except (TypeError, KeyError) as e:
            return self._error(request["id"], -32602, str(e))
        except Exception as e:  # noqa: BLE001  a client gets every failure as an answer
            return self._error(request["id"], -32603, str(e))
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    def _call(self, params: dict) -> dict:
        name, given = params["name"], dict(params.get("arguments") or {})
        if name == "index" or self.graph is None:
            self.graph = build(self.spark, self.root)
        if name == "index":
            return {"content": [{"type": "text", "text": commands.overview(self.graph).text()}]}
        budget = given.pop("budget", 0) or 2000
        targets = given.pop("seeds", None) or ([given.pop("target")] if "target" in given else [])
        try:
            return {"content": [{"type": "text", "text": ask(self.graph, self.root, name, targets, **given).text(budget)}]}
        except ValueError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    @staticmethod
    def _error(id_: object, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in filter(str.strip, lines):
            try:
                answer = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                answer = self._error(None, -32700, str(e))
            if answer is not None:
                print(json.dumps(answer, default=str), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    sub = parser.add_subparsers(dest="do", required=True)
    for name in ("index", "map", "mcp"):
        p = sub.add_parser(name)
        p.add_argument("root", nargs="?", default=".")
        p.add_argument("--out")
        p.add_argument("--json", action="store_true")
        p.add_argument("--force", action="store_true")
        p.add_argument("--all", action="store_true", help="also files that .gitignore leaves out")
        p.add_argument("--regex", action="store_true", help="no syntax trees")
        p.add_argument("--frontends", help="languages whose own reader is used, comma-separated: " + ",".join(FRONTENDS))
        p.add_argument("--max-nodes", type=int, default=2500)
        p.add_argument("--port", type=int, default=serve.PORT)
        p.add_argument("--view", choices=("nebula", "atlas"), default="nebula")
        p.add_argument("--no-open", action="store_true")
        p.add_argument("--build-only", action="store_true")
        p.add_argument("--quiet", action="store_true")
    p = sub.add_parser("q")
    p.add_argument("command")
    p.add_argument("targets", nargs="*")
    p.add_argument("--index", default=".")
    p.add_argument("--budget", type=int, default=2000)
    p.add_argument("--json", action="store_true")
    p.add_argument("--transitive", action="store_true", default=None)
    for option, kind in (("depth", int), ("limit", int), ("context", int), ("kinds", str), ("kind", str), ("direction", str)):
        p.add_argument(f"--{option}", type=kind)
    a = parser.parse_args(argv)
    if a.do == "q" and a.budget <= 0:
        parser.error("--budget must be positive")
    spark = local_session()
    try:
        if a.do == "mcp":
            Server(spark, a.root).serve(sys.stdin, sys.stdout)
        elif a.do == "q":
            home = locate(a.index)
            answer = ask(CodeGraph.read(spark, str(home)), str(home.parent), a.command, a.targets, **{k: getattr(a, k) for k in ("depth", "limit", "context", "kinds", "kind", "direction", "transitive")})
            print(json.dumps(answer.plain(), default=str) if a.json else answer.text(a.budget))
        else:
            graph = build(spark, a.root, a.out if a.do == "index" else None, a.force, a.all, () if a.regex else tuple(a.frontends.split(",")) if a.frontends else True)
            if a.do == "index":
                seen = commands.overview(graph)
                if not a.quiet:
                    print(json.dumps(seen.values, default=str) if a.json else seen.text())
            else:
                made = report(graph, a.max_nodes, a.root, a.view)
                folder = serve.write_report(made, a.out or str(Path(a.root) / HOME / "map"))
                scores = made["scores"]
                print(json.dumps(made if a.json and a.build_only else scores, default=str) if a.json else "\n".join([f"{scores['grade']} {scores['overall']}", *(f"{name} {m['score']}" for name, m in scores["metrics"].items()), *scores["notes"]]))
                if not a.build_only:
                    show(folder, a.root, a.port, not a.no_open)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
