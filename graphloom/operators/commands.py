"""The thirteen structural questions over a code graph.

Each takes a CodeGraph and returns an Answer: named DataFrames, a few scalars, and text cut
to a token budget. Lists are capped, and every cap is told beside the true total; with a limit of
None, callees and dependents come whole, and only their text lines are cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, conf_tag, kinds_of
from graphloom.operators import graph, rollup, search
from graphloom.operators.calls import GUESS_BELOW
from graphloom.sources.index import CodeGraph

NEIGHBOURS, IMPORTERS, OPEN_SITES, ENTRIES = 500, 200, 50, 8
CODE_WIDTH = 100
#: Names of files that start something, and paths of tests.
LAUNCHER = r"(?i)(^|/)(main|index|app|cli|server|run|__main__|setup|entry)\b"
TEST_PATH = r"(^|/)tests?/|(^|/)spec/|(^|/)test_[^/]*$|[._-]tests?\.[a-z]+$|(?<=[a-z])Tests?\.[A-Za-z]+$"


@dataclass
class Answer:
    """Scalars, tables and ordered text lines of one command."""

    values: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list)

    def text(self, budget: int = 2000) -> str:
        """Lines while they fit: a line costs a quarter of its length, rounded up, plus one."""
        most, used, out = max(64, budget) - 12, 0, []
        for line in self.lines:
            used += -(-len(line) // 4) + 1
            if used > most:
                out.append(f"... {len(self.lines) - len(out)} more lines, cut by the budget")
                break
            out.append(line)
        return "\n".join(out)

    def plain(self) -> dict:
        return self.values | {k: [r.asDict(recursive=True) for r in t.collect()] for k, t in self.tables.items()}


class NotFound(ValueError):
    """Nothing in the graph goes by that name."""


def _one(g: CodeGraph, target: str, kinds: str | None = None):
    row = search.resolve(g.nodes, target, kinds).first()
    if row is None:
        raise NotFound(f"nothing matches {target!r}")
    return row


def _listed(a: Answer, title: str, table: DataFrame, line: Callable, total: int | None = None, most: int | None = None) -> None:
    """The lines of a table, or of its first rows."""
    rows = table.collect() if most is None else table.limit(most).collect()
    shown = f"{len(rows)} of {total}" if total is not None and total > len(rows) else f"{len(rows)}"
    a.lines.append(f"{title} ({shown})")
    a.lines += [f"  {line(r)}" for r in rows]


def _named(g: CodeGraph, ids: DataFrame) -> DataFrame:
    return ids.join(g.nodes.select("id", "kind", "name", "path", "line"), "id")


def _where(r) -> str:
    return f"{r['name']} {r['path'] or ''}" + (f":{r['line']}" if r["line"] is not None else "")


def entry_points(code: DataFrame, mains: DataFrame, edges: DataFrame, limit: int = ENTRIES, pool: int | None = None) -> DataFrame:
    """path, why and score of the files that start something, best first.

    code: id, path and outdeg of code files; mains: path of files with a main function. All files
    are looked at but tests; a file that nothing speaks for still takes a free place. pool: only
    so many files that depend on most others, and those with a main function, are looked at.
    """
    mains = mains.select("path").distinct().withColumn("main", F.lit(True))
    used = edges.filter("kind = 'imports'").select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(True))
    if pool is not None:
        code = code.orderBy(F.desc("outdeg"), "id").limit(pool).union(code.join(mains, "path", "left_semi").select(*code.columns)).dropDuplicates(["id"])
    named = code.join(mains, "path", "left").join(used, "id", "left").filter(~F.col("path").rlike(TEST_PATH))
    launch = basename(F.col("path")).rlike(LAUNCHER)
    score = F.when(F.col("main"), 100).otherwise(0) + F.when(launch, 40).otherwise(0) + F.when(F.col("used").isNull(), 10).otherwise(0)
    why = F.when(F.col("main"), "main()").when(launch, "named").otherwise("unimported")
    return named.withColumn("score", score).orderBy(F.desc("score"), F.desc("outdeg"), "id").limit(limit).select("path", why.alias("why"), "score")


def starts(g: CodeGraph, files: DataFrame) -> DataFrame:
    """entry_points() of the code files of a graph."""
    mains = g.nodes.filter((F.col("kind") == "Function") & F.col("name").isin("main", "Main", "__main__"))
    code = g.nodes.filter("kind = 'File'").join(files.select("path"), "path", "left_semi").select("id", "path", "outdeg")
    return entry_points(code, mains, g.edges)


def overview(g: CodeGraph) -> Answer:
    a = Answer()
    files = g.files.filter("kind = 'code'")
    stats = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum("unparsed"), F.lit(0)).alias("unparsed"), F.count_if(F.col("unparsed") > 0).alias("files_with_unparsed")).first()
    kinds = {r["kind"]: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    a.values |= stats.asDict() | g.counters.first().asDict() | {"functions": kinds.get("Function", 0), "classes": kinds.get("Class", 0), "nodes": sum(kinds.values())}
    a.tables["edge_kinds"] = g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")
    a.tables["languages"] = files.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("frontend") != "regex").alias("compiled")).orderBy(F.desc("files"), "lang")
    a.tables["top_dirs"] = rollup.collapsed(rollup.directories(files.select("path", "loc"))).orderBy(F.desc("loc"), "dir").limit(12)
    a.tables["entry_points"] = starts(g, files)
    into = g.edges.filter("kind = 'imports'").groupBy("dst").agg(F.count(F.lit(1)).alias("importers"))
    a.tables["hubs"] = into.filter(F.col("dst").startswith("f:")).orderBy(F.desc("importers"), "dst").limit(8)
    a.tables["libraries"] = into.filter(F.col("dst").startswith("lib:")).orderBy(F.desc("importers"), "dst").limit(12)
    edges = " ".join(f"{r['kind']}:{r['n']}" for r in a.tables["edge_kinds"].collect())
    a.lines.append(f"{a.values['files']} code files, {a.values['loc']:,} lines, {a.values['functions']} functions, {a.values['classes']} classes; {a.values['nodes']} nodes, {edges}")
    a.lines.append(f"calls bound {a.values['bound']}, ambiguous {a.values['ambiguous']}, coverage {a.values['coverage']} %")
    if a.values["unparsed"]:
        a.lines.append(f"{a.values['unparsed']} lines in {a.values['files_with_unparsed']} files look like declarations and gave no symbol")
    _listed(a, "languages", a.tables["languages"], lambda r: f"{r['lang']} {r['files']}" + (f" ({r['compiled']} by syntax tree)" if r["compiled"] else ""))
    _listed(a, "directories", a.tables["top_dirs"], lambda r: f"{r['dir']} {r['files']} files {r['loc']:,} lines")
    _listed(a, "entry points", a.tables["entry_points"], lambda r: f"{r['path']} {r['why']}")
    _listed(a, "most imported", a.tables["hubs"], lambda r: f"{r['dst'][2:]} {r['importers']}")
    _listed(a, "libraries", a.tables["libraries"], lambda r: f"{r['dst'][4:]} {r['importers']}")
    return a


def find(g: CodeGraph, target: str, kind: str | None = None, limit: int = 200) -> Answer:
    a = Answer({"query": target, "kind": kind})
    a.tables["matches"] = search.resolve(g.nodes, target, kind, limit)
    first = a.tables["matches"].first()
    a.values["total"] = first["total"] if first else 0
    _listed(a, "matches", a.tables["matches"], lambda r: f"{r['kind']} {_where(r)}", a.values["total"])
    return a


def outline(g: CodeGraph, target: str) -> Answer:
    node = _one(g, target, "file")
    a = Answer({"file": node["path"]})
    a.tables["symbols"] = g.nodes.filter((F.col("path") == node["path"]) & F.col("kind").isin("Class", "Function")).orderBy("line", "id").select("id", "kind", "name", "parent", "line", "length")
    a.tables["imports"] = g.near("src", [node["id"]], ["imports"]).select("dst").orderBy("dst")
    importers = graph.one_hop(g.near("dst", [node["id"]]), node["id"], "in", "imports", IMPORTERS)
    a.tables["importers"] = importers.select("id")
    first = importers.first()
    a.values["importer_total"] = first["total"] if first else 0
    a.lines.append(node["path"])
    _listed(a, "symbols", a.tables["symbols"], lambda r: f"{r['line']} {r['kind']} {(r['parent'] + '.') if r['parent'] else ''}{r['name']} ({r['length']} lines)")
    _listed(a, "imports", a.tables["imports"], lambda r: r["dst"])
    _listed(a, "imported by", a.tables["importers"], lambda r: r["id"], a.values["importer_total"])
    return a


def code_lines(source: Callable[[str], bytes] | None) -> Callable[[str, int | None], str]:
    """The code at a line of a file, trimmed and cut to `CODE_WIDTH`; empty where there is none."""
    read: dict[str, list[str]] = {}

    def at(path: str, line: int | None) -> str:
        if path not in read:
            try:
                read[path] = source(path).decode("utf-8", "ignore").splitlines() if source else []
            except OSError:
                read[path] = []
        if not line or line > len(read[path]):
            return ""
        text = read[path][line - 1].strip()
        return text if len(text) <= CODE_WIDTH else text[: CODE_WIDTH - 1] + "…"

    return at


SITES = "path string, line int, caller string, conf double, code string"


def who_calls(g: CodeGraph, target: str, source: Callable[[str], bytes] | None = None) -> Answer:
    """Callers of a symbol at their call sites, with the code there, and whether the list is complete."""
    node = _one(g, target, "function class")
    hit = g.near("dst", [node["id"]], ["calls"]).select(F.col("src").alias("id"), "conf", "lines")
    open_ = g.unbound.filter(F.col("name") == node["name"])
    total, guesses, unresolved = hit.count(), hit.filter(F.col("conf") < GUESS_BELOW).count(), open_.count()
    a = Answer({"target": node["id"], "ambiguous": node["total"] - 1, "total": total, "guesses": guesses, "unresolved_total": unresolved, "complete": not guesses and not unresolved and total <= NEIGHBOURS})
    a.tables["callers"] = _named(g, hit.orderBy(F.desc("conf"), "id").limit(NEIGHBOURS)).withColumn("tag", conf_tag(F.col("conf"))).orderBy(F.desc("conf"), "path", "id")
    spark, code = g.nodes.sparkSession, code_lines(source)
    sites = [(r["path"], line, r["name"], r["conf"], code(r["path"], line)) for r in a.tables["callers"].collect() for line in r["lines"] or [r["line"]]]
    a.tables["sites"] = spark.createDataFrame(sites, SITES)
    caller = g.nodes.select(F.col("id").alias("src"), F.col("name").alias("caller"))
    left = open_.join(caller, "src", "left").select("path", "line", F.coalesce("caller", "path").alias("caller")).orderBy("path", "line", "caller").limit(OPEN_SITES).collect()
    a.tables["unresolved"] = spark.createDataFrame([(r["path"], r["line"], r["caller"], None, code(r["path"], r["line"])) for r in left], SITES).drop("conf")
    a.lines.append(f"{node['name']} {node['path']}:{node['line']}: {total} callers" + (f", {NEIGHBOURS} shown" if total > NEIGHBOURS else ""))
    shown = lambda path, line, name, tag, text: f"  {path}:{line} {name}{tag}" + (f"  | {text}" if text else "")
    a.lines += [shown(path, line, name, "" if conf >= GUESS_BELOW else " ~" if conf >= 0.8 else " ?", text) for path, line, name, conf, text in sites]
    if a.values["ambiguous"]:
        a.lines.append(f"{a.values['ambiguous']} other symbols match {target}; path:name tells them apart")
    if a.values["complete"]:
        a.lines.append(f"complete: every call site named {node['name']} is bound, none by its name alone")
    if guesses:
        a.lines.append(f"{guesses} callers are matched by name only (~ by import, ? as the only one); the code shown is the evidence")
    if unresolved:
        a.lines.append(f"{unresolved} call sites named {node['name']} could mean this or another" + (f"; {OPEN_SITES} shown" if unresolved > OPEN_SITES else ""))
        a.lines += [shown(r["path"], r["line"], r["caller"], "", code(r["path"], r["line"])) for r in left]
    return a


def calls(g: CodeGraph, target: str, limit: int | None = NEIGHBOURS) -> Answer:
    """What a symbol calls, best confidence first; a limit of None gives all of it."""
    node = _one(g, target, "function class file")
    hop = graph.one_hop(g.near("src", [node["id"]]), node["id"], "out", "calls", limit)
    a = Answer({"target": node["id"], "ambiguous": node["total"] - 1})
    a.tables["callees"] = _named(g, hop.select("id", "conf")).withColumn("tag", conf_tag(F.col("conf"))).orderBy(F.desc("conf"), "path", "id")
    first = hop.first()
    a.values["total"] = first["total"] if first else 0
    _listed(a, f"{node['name']} calls", a.tables["callees"], lambda r: f"{_where(r)}{r['tag']}", a.values["total"], NEIGHBOURS)
    return a


def _reach(g: CodeGraph, kinds: str | list[str] | None, ids: list[str], depth: int, direction: str, cap: int | None = graph.VISITED_CAP) -> DataFrame:
    """graph.reach over edges of the given kinds, looked up hop by hop where a cap bounds it."""
    kinds = (kinds or "calls imports").replace(",", " ").split() if not isinstance(kinds, list) else kinds
    return graph.reach(graph.of_kinds(g.edges, kinds), _seed(g, *ids), depth, direction, cap, near=lambda end, at: g.near(end, at, kinds))


def _seed(g: CodeGraph, *ids: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def neighbors(g: CodeGraph, target: str, depth: int = 2, kinds: str | None = None, direction: str = "both") -> Answer:
    node = _one(g, target)
    reached = _reach(g, kinds, [node["id"]], depth, direction)
    a = Answer({"target": node["id"], "depth": depth, "capped": bool(reached.first()["capped"])})
    a.tables["neighbors"] = _named(g, reached.filter(F.col("id") != node["id"])).orderBy("hop", F.coalesce("path", F.lit("")), "id")
    _listed(a, f"within {depth} of {node['name']}" + (" (capped)" if a.values["capped"] else ""), a.tables["neighbors"], lambda r: f"{r['hop']} {_where(r)}")
    return a


def _depends(g: CodeGraph, target: str, direction: str, transitive: bool, limit: int | None) -> Answer:
    node = _one(g, target, "file dir library")
    reached = _reach(g, ["imports"], [node["id"]], 12 if transitive else 1, direction, graph.VISITED_CAP if limit is not None else None)
    a = Answer({"target": node["id"], "transitive": transitive, "capped": bool(reached.first()["capped"])})
    every = _named(g, reached.filter(F.col("id") != node["id"])).orderBy("hop", F.coalesce("path", F.lit("")), "id")
    a.values["total"] = every.count()
    a.tables["deps"] = every if limit is None else every.limit(limit)
    _listed(a, f"{'imports of' if direction == 'out' else 'importers of'} {node['name']}", a.tables["deps"], lambda r: f"{r['hop']} {r['path'] or r['name']}", a.values["total"], NEIGHBOURS)
    return a


def deps(g: CodeGraph, target: str, transitive: bool = False) -> Answer:
    return _depends(g, target, "out", transitive, NEIGHBOURS)


def dependents(g: CodeGraph, target: str, transitive: bool = False, limit: int | None = NEIGHBOURS) -> Answer:
    """What imports a file, folder or library; a limit of None gives all of it, however many are reached."""
    return _depends(g, target, "in", transitive, limit)


def _by_file(found: DataFrame) -> DataFrame:
    item = F.struct("hop", "line", "name")
    return found.groupBy(F.coalesce("path", "name").alias("path")).agg(F.min("hop").alias("hop"), F.array_sort(F.collect_list(item)).alias("symbols")).orderBy("hop", "path")


def _nearest(r) -> str:
    near = [s["name"] for s in r["symbols"] if s["hop"] == r["hop"]]
    deeper = len(r["symbols"]) - len(near)
    return f"{r['hop']} {r['path']}: {', '.join(near[:8])}" + (f" +{len(near) - 8}" if len(near) > 8 else "") + (f" (+{deeper} deeper)" if deeper else "")


def impact(g: CodeGraph, target: str, depth: int = 3) -> Answer:
    node = _one(g, target)
    reached = _reach(g, None, [node["id"]], depth, "in")
    found = _named(g, reached.filter(F.col("id") != node["id"]))
    a = Answer({"target": node["id"], "depth": depth, "capped": bool(reached.first()["capped"]), "reached": found.count()})
    a.tables["by_file"] = _by_file(found)
    a.values["files"] = a.tables["by_file"].count()
    a.lines.append(f"a change of {node['name']} reaches {a.values['reached']} symbols in {a.values['files']} files" + (" (capped)" if a.values["capped"] else ""))
    _listed(a, "files", a.tables["by_file"], _nearest)
    return a


def subgraph(g: CodeGraph, seeds: list[str], depth: int = 2, kinds: str | None = None) -> Answer:
    hits = {s: search.resolve(g.nodes, s, limit=3).first() for s in seeds}
    ids = [r["id"] for r in hits.values() if r]
    a = Answer({"seeds": ids, "unresolved": [s for s, r in hits.items() if not r], "depth": depth})
    if not ids:
        raise NotFound(f"nothing matches {seeds!r}")
    reached = _reach(g, kinds, ids, depth, "both")
    found = _named(g, reached)
    a.values |= {"capped": bool(reached.first()["capped"]), "nodes": found.count()}
    a.tables["by_file"] = _by_file(found.filter(~F.col("kind").isin("Dir", "Library")))
    a.values["files"] = a.tables["by_file"].count()
    a.lines.append(f"{a.values['nodes']} nodes in {a.values['files']} files around {', '.join(ids)}")
    _listed(a, "files", a.tables["by_file"], _nearest)
    return a


def span(g: CodeGraph, target: str, source: Callable[[str], bytes], context: int = 0) -> Answer:
    """The lines of one symbol as they are now; stale if the file has changed since."""
    import hashlib

    node = _one(g, target, "function class file")
    content = source(node["path"])
    lines = content.decode("utf-8", "replace").splitlines()
    row = g.files.filter(F.col("path") == node["path"]).first()
    size = g.nodes.filter(F.col("id") == node["id"]).first()["length"] or len(lines)
    start = max(1, (node["line"] or 1) - context)
    end = min(len(lines), (node["line"] or 1) + size - 1 + context)
    a = Answer({"target": node["id"], "ambiguous": node["total"] - 1, "stale": hashlib.sha1(content).hexdigest() != row["hash"], "start": start, "end": end})
    a.lines = [f"{node['path']}:{start}-{end}" + (" STALE" if a.values["stale"] else "")] + [f"{i} {lines[i - 1]}" for i in range(start, end + 1)]
    return a


def hubs(g: CodeGraph, limit: int = 20) -> Answer:
    a = Answer()
    used = g.edges.filter(F.col("dst").startswith("f:"))
    a.tables["files"] = graph.file_hubs(used).orderBy(F.desc(F.col("importers") + F.col("imports_out")), "id").limit(limit)
    a.tables["functions"] = g.nodes.filter("kind = 'Function' and indeg > 0").orderBy(F.desc("indeg"), "id").limit(limit).select("id", "name", "path", "line", "indeg")
    _listed(a, "files", a.tables["files"], lambda r: f"{r['id'][2:]} in {r['importers']} out {r['imports_out']}")
    _listed(a, "functions", a.tables["functions"], lambda r: f"{_where(r)} {r['indeg']} callers")
    return a


def cycles(g: CodeGraph) -> Answer:
    files = g.edges.filter((F.col("kind") == "imports") & F.col("dst").startswith("f:"))
    a = Answer()
    a.tables["cycles"] = graph.strong_components(files).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy(F.desc(F.size("members")), "component")
    a.values["count"] = a.tables["cycles"].count()
    _listed(a, "import cycles", a.tables["cycles"], lambda r: " -> ".join(m[2:] for m in r["members"]))
    return a


COMMANDS: dict[str, Callable] = {"overview": overview, "find": find, "outline": outline, "who-calls": who_calls, "calls": calls, "neighbors": neighbors, "deps": deps, "dependents": dependents, "impact": impact, "subgraph": subgraph, "span": span, "hubs": hubs, "cycles": cycles}


def run(g: CodeGraph, command: str, **arguments) -> Answer:
    """One command by name; depths are not negative, kinds are checked by the operators."""
    if arguments.get("depth", 0) < 0:
        raise ValueError("depth must not be negative")
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}; there are {', '.join(COMMANDS)}")
    if "kind" in arguments:
        kinds_of(arguments["kind"])
    return COMMANDS[command](g, **arguments)
