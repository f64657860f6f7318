"""Trees of source files to graphs: scanning, parsing, resolving."""

import pytest

from graphloom.operators import calls, search
from graphloom.sources import index as ix
from graphloom.sources import scan
from graphloom.sources.languages import LANGUAGES
from graphloom.sources.parse import blank_noise, facts, joined_lines


def write(root, tree):
    for name, text in tree.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


TREE = {
    "app/main.py": "from .helpers import compute\n\n\ndef run():\n    return compute(2)\n\n\ndef unused():\n    pass\n\n\nif __name__ == '__main__':\n    run()\n",
    "app/helpers.py": "import os.path\n\n\ndef compute(n):\n    return double(n)\n\n\ndef double(n):\n    # compute(n) in a comment\n    return 'double(n)' and n * 2\n",
    "vendorlib/helpers.rb": "def compute(n)\n  n\nend\n",
    ".gitignore": "generated/\n*.tmp.py\n!keep.tmp.py\n",
    "generated/build.py": "def made(): pass\n",
    "scratch.tmp.py": "def scratch(): pass\n",
    "keep.tmp.py": "def kept(): pass\n",
    "node_modules/x.js": "function gone() {}\n",
    "svc/pom.xml": "<project/>\n",
    "svc/target/Gone.java": "class Gone {}\n",
    "svc/src/target.py": "def stays(): pass\n",
    "README.md": "# readme\n",
    "a.py": "def handle():\n    pass\n",
    "b.py": "def handle():\n    pass\n",
    "c.py": "def go(x):\n    x.handle()\n",
    "store.py": "class Store:\n    def save(self):\n        pass\n\n\nclass Cache:\n    def save(self):\n        pass\n",
    "svc.py": "from store import Store as S, Cache\n\n\ndef typed(s: S):\n    s.save()\n\n\nclass Box(Cache):\n    def __init__(self):\n        self.inner = S()\n\n    def keep(self):\n        self.save()\n        self.inner.save()\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return ix.index(spark, write(tmp_path_factory.mktemp("tree"), TREE))


def pairs(graph, kind):
    return {(r.src, r.dst) for r in graph.edges.filter(f"kind = '{kind}'").collect()}


def test_scan_drops_what_is_ignored(built):
    paths = {r.path for r in built[0].files.collect()}
    assert paths == set(TREE) - {".gitignore", "generated/build.py", "scratch.tmp.py", "node_modules/x.js", "svc/target/Gone.java"}


def test_imports_stay_in_their_language(built):
    found = pairs(built[0], "imports")
    assert ("f:app/main.py", "f:app/helpers.py") in found and ("f:app/helpers.py", "lib:os") in found
    assert not any("helpers.rb" in d for _, d in found)


def test_calls_bind_by_scope_and_never_from_comments(built):
    edges = {(r.src, r.dst): (r.conf, r.lines) for r in built[0].edges.filter("kind = 'calls'").collect()}
    assert edges[("s:app/main.py#run", "s:app/helpers.py#compute")] == (0.97, [5])
    assert edges[("f:app/main.py", "s:app/main.py#run")] == (0.95, [13])
    assert ("s:app/helpers.py#double", "s:app/helpers.py#compute") not in edges
    nodes = {(r.path, r.name, r.parent): r.id for r in built[0].nodes.filter("kind = 'Function'").collect()}
    store, cache = (nodes[("store.py", "save", c)] for c in ("Store", "Cache"))
    assert store != cache
    assert edges[("s:svc.py#typed", store)] == (0.97, [5])
    assert edges[("s:svc.py#keep", cache)][1] == [13] and edges[("s:svc.py#keep", store)][1] == [14]


def test_the_last_import_of_an_alias_wins_and_links_count_once(spark, tmp_path):
    import os

    root = write(tmp_path, {"x/util.rb": "def go(a)\n  a\nend\n", "y/util.rb": "def go(a)\n  a\nend\n", "main.rb": "require 'x/util'\nrequire 'y/util'\ndef run(a)\n  util.go(a)\nend\n", ".hidden/gone.rb": "def gone\nend\n"})
    os.symlink(f"{root}/x/util.rb", f"{root}/zlink.rb")
    os.symlink(f"{root}/x", f"{root}/zfolder")
    g, _ = ix.index(spark, root)
    assert {r.path for r in g.files.collect()} == {"x/util.rb", "y/util.rb", "main.rb"}
    assert {(r.src, r.dst, r.conf) for r in g.edges.filter("kind = 'calls'").collect()} == {("s:main.rb#run", "s:y/util.rb#go", 0.9)}


def test_ambiguous_methods_stay_open(built):
    assert {(r.name, r.src, r.line) for r in built[0].unbound.collect()} == {("handle", "s:c.py#go", 2)}
    row = built[0].counters.first()
    assert row.ambiguous == 1 and row.bound >= 6


def test_degrees_and_ends(built):
    graph = built[0]
    ids = {r.id for r in graph.nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in graph.edges.collect())
    assert graph.nodes.filter("id = 'f:app/helpers.py'").first().indeg == 1


def test_reindex_parses_only_changes(spark, tmp_path, built):
    root = write(tmp_path, {"m.py": "\n\ndef one(): pass\n", "n.py": "def two(): pass\n"})
    first, facts_ = ix.index(spark, root)
    (tmp_path / "n.py").unlink()
    write(tmp_path, {"m.py": "# moved\n\n\n\ndef one(): pass\n"})
    second, _ = ix.index(spark, root, cached=facts_)
    symbol = lambda g: {r.id: r.line for r in g.nodes.filter("kind = 'Function'").collect()}
    assert symbol(first) == {"s:m.py#one": 3, "s:n.py#two": 1} and symbol(second) == {"s:m.py#one": 5}
    second.write(str(tmp_path / "out"))
    assert ix.CodeGraph.read(spark, str(tmp_path / "out")).nodes.count() == second.nodes.count()


SNIPPETS = {
    "python": ("def found(a,\n          b):\n    return a\nclass Kind:\n    pass\n# def hidden(): pass\ns = 'def quoted(): pass'\n", {"found", "Kind"}),
    "javascript": ("function found(a,\n  b) {\n  if (a) { go(b) }\n}\nconst arrow = (x) => x\nclass Kind {\n  method(a) {\n    return a\n  }\n}\n// function hidden() {}\nconst s = 'function quoted() {}'\n", {"found", "arrow", "Kind", "method"}),
    "typescript": ("export function found(a: string): void {\n}\ninterface Kind {\n}\n/* function hidden() {} */\n", {"found", "Kind"}),
    "java": ("public class Kind {\n  public int found(int a,\n      int b) throws IOException {\n    if (a) { return b; }\n    return other(a);\n  }\n  abstract void open(int x);\n  /* void hidden() {} */\n}\n", {"Kind", "found", "open"}),
    "kotlin": ("data class Kind(val a: Int)\nfun found(a: Int): Int {\n  return a\n}\n// fun hidden() {}\n", {"Kind", "found"}),
    "go": ("type Kind struct {\n}\nfunc (k *Kind) found(a int) int {\n\treturn a\n}\n// func hidden() {}\n", {"Kind", "found"}),
    "rust": ("pub struct Kind {}\npub fn found<'a>(x: &'a str) -> bool {\n    true\n}\n// fn hidden() {}\n", {"Kind", "found"}),
    "c": ("struct kind {\n  int a;\n};\nstatic int found(int a,\n                 int b) {\n  return a;\n}\n/* int hidden(int a) { } */\n", {"kind", "found"}),
    "cpp": ("class Kind {\n};\nint Kind::found(int a) const {\n  return a;\n}\n// int hidden() {}\n", {"Kind", "found"}),
    "csharp": ("public class Kind {\n  public int Found(int a) {\n    return a;\n  }\n}\n// int Hidden() {}\n", {"Kind", "Found"}),
    "ruby": ("class Kind\n  def found(a)\n    a\n  end\nend\n# def hidden; end\n", {"Kind", "found"}),
    "php": ("class Kind {\n  public function found($a) {\n    return $a;\n  }\n}\n// function hidden() {}\n", {"Kind", "found"}),
    "swift": ("struct Kind {\n}\npublic func found(a: Int) -> Int {\n  return a\n}\n// func hidden() {}\n", {"Kind", "found"}),
    "scala": ("case class Kind(a: Int)\ndef found(a: Int): Int = a\n// def hidden() = 1\n", {"Kind", "found"}),
    "dart": ("class Kind {\n}\nint found(int a) {\n  return a;\n}\n// int hidden() {}\n", {"Kind", "found"}),
    "shell": ("found() {\n  echo x\n}\nfunction other {\n  echo y\n}\n# hidden() { }\n", {"found", "other"}),
    "lua": ("local function found(a)\n  return a\nend\n-- function hidden() end\n", {"found"}),
    "r": ("found <- function(a) {\n  a\n}\n# hidden <- function() 1\n", {"found"}),
    "elixir": ("defmodule Kind do\n  def found(a) do\n    a\n  end\nend\n# def hidden do\n", {"Kind", "found"}),
}


JAVA = {
    "src/p/A.java": "package p;\n\nimport java.util.List;\nimport org.lib.Thing;\n\n/** Docs. */\npublic class A {\n    private final B b = new B();\n\n    public int go(List<String> x) {\n        b.run();\n        new B(2).run();\n        x.size();\n        Thing.make().run();\n        return help(1);\n    }\n\n    @Deprecated\n    static int help(int n) {\n        return n;\n    }\n}\n",
    "src/p/B.java": "package p;\n\nclass B {\n    B() {}\n\n    B(int n) {}\n\n    void run() {}\n}\n",
    "src/q/C.java": "package q;\n\nclass C {\n    void run() {}\n}\n",
    "src/q/Broken.java": "package q;\n\nclass Broken {\n    void half( {\n}\n",
}


def test_java_is_bound_by_the_compiler(spark, tmp_path):
    from graphloom.sources import java_frontend

    assert java_frontend.source_root("src/p/A.java", JAVA["src/p/A.java"]) == "src" and java_frontend.source_root("x/A.java", "package p;") is None
    if not java_frontend.available():
        pytest.skip("no Java compiler")
    g, _ = ix.index(spark, write(tmp_path, JAVA))
    kind = {r.path: r.frontend for r in g.files.collect()}
    assert kind == {"src/p/A.java": "javac", "src/p/B.java": "javac", "src/q/C.java": "javac", "src/q/Broken.java": "regex"}
    symbols = {(r.path, r.name, r.line): (r.length, r.documented, r.parent) for r in g.nodes.filter("kind in ('Class', 'Function')").collect()}
    assert symbols["src/p/A.java", "A", 7] == (16, True, None) and symbols["src/p/A.java", "help", 19] == (3, False, "A")
    names = {r.id: (r.name, r.line) for r in g.nodes.collect()}
    edges = {(names[r.src][0], names[r.dst]): (r.conf, r.lines) for r in g.edges.filter("kind = 'calls'").collect()}
    # two methods are named run; the compiler knows which is meant, and that others lie outside
    assert edges == {("go", ("run", 8)): (1.0, [11, 12]), ("go", ("B", 6)): (1.0, [12]), ("go", ("help", 19)): (1.0, [15]), ("A", ("B", 4)): (1.0, [8])}
    row = g.counters.first()
    assert row.compiled == 5 and row.external == 3 and row.ambiguous == 0
    plain, _ = ix.index(spark, str(tmp_path), frontends=("python",))
    assert {r.frontend for r in plain.files.collect()} == {"regex"} and plain.counters.first().compiled == 0


def test_every_language_has_a_snippet():
    assert set(SNIPPETS) == {language.name for language in LANGUAGES}


@pytest.mark.parametrize("lang", SNIPPETS)
@pytest.mark.parametrize("frontends", [True, False])
def test_symbols(lang, frontends):
    text, want = SNIPPETS[lang]
    f = facts("x", lang, "code", text.encode(), frontends)
    assert {s["name"] for s in f["symbols"]} == want
    assert f["code_lines"] + f["comment_lines"] + f["blank_lines"] == f["loc"]


def test_fixed_values_decide_as_they_must():
    from graphloom.sources.languages import BRANCHES, SKIPPED_SUFFIXES

    assert len(BRANCHES.findall("x ? a : b; y ?? z; foreach (x) rescue; else if (a); a =? b; unless match")) == 5
    assert "-lock.json" in SKIPPED_SUFFIXES and "_pb2.py" not in SKIPPED_SUFFIXES
    assert "settings.gradle" in scan.MANIFESTS and "jspm_packages" in scan.IGNORED_DIRS and "setup.py" not in scan.MANIFESTS
    # spans run while lines are deeper; complexity counts to the next symbol; a comment above documents
    f = facts("x.go", "go", "code", b"// adds\nfunc add(a int) int {\n\tif a > 0 {\n\t\treturn helper(a)\n\t}\n}\n\nif x {\n}\nfunc other() {\n}\n")
    one, two = f["symbols"]
    assert (one["line"], one["length"], one["complexity"], one["documented"], two["documented"]) == (2, 4, 3, True, False)
    assert [(r["name"], r["line"]) for r in f["refs"]] == [("helper", 4)] and f["unparsed"] == 0
    assert facts("x.java", "java", "code", b"class A {\n  Foo bar(\n}\nint weird(int a) what;\nstatic int lost(int x)\n")["unparsed"] >= 0


def test_columns_of_names(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import text as T
    from graphloom.operators import commands as c

    raws = {"javax.swing.X": "javax.swing", "de.foo.Bar": "de", "type": "type", "export": None, "os.path": "os", "@scope/pkg": "@scope", "#66b8ff": None, "from": None, "": None, "<stdio.h>": "stdio", "'x'": "x", "std::vec": "std", "../up": None, "a" * 41: None, ".": None, "org": "org"}
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", T.library_name(F.col("raw")).alias("library")).collect()
    assert {r.raw: r.library for r in got} == raws
    paths = {"src/FooTests.java": (True, False), "setup.py": (False, True), "app/x.py": (False, False), "tests/a.py": (True, False), "x/test_a.py": (True, False), "entry.ts": (False, True), "mainly.py": (False, False), "a/latest.py": (False, False)}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", F.col("p").rlike(c.TEST_PATH).alias("t"), T.basename(F.col("p")).rlike(c.LAUNCHER).alias("l")).collect()
    assert {r.p: (r.t, r.l) for r in rows} == paths
    assert T.kinds_of("cls module") == ["Class", "Dir"]
    folded = spark.createDataFrame([("ÄBC", 1)], "x string, n int").select(T.like_ci(F.col("x"), "äb").alias("a"), T.like_ci(F.col("x"), "bc").alias("b")).first()
    assert (folded.a, folded.b) == (False, True)


def test_noise_keeps_lines_and_columns():
    by = {language.name: language for language in LANGUAGES}
    text = 'x = "a /* b" # c\ny = """\nz()\n"""\n'
    out = blank_noise(text, by["python"])
    assert [len(a) == len(b) for a, b in zip(out.split("\n"), text.split("\n"), strict=True)] and "z" not in out
    assert "call" in blank_noise('a("/*"); call();', by["java"])
    assert joined_lines(["f(a,", "  b) {", "x"]) == (["f(a, b) {", "  b) {", "x"], {1})
    assert joined_lines(["int f(a)", "    throws X", "  {", "y()"])[0][0] == "int f(a) throws X {" and joined_lines(["f(", *["a,"] * 9, ")"])[1] == set()


def test_gitignore_globs():
    import re

    rules = {r[2]: r for r in scan.ignore_rules("", "/root.py\nsrc/*.py\n**/deep/*.log\n")}
    hit = lambda path: [bool(re.match(r, path)) for r in rules]
    assert hit("root.py") == [True, False, False] and hit("a/root.py") == [False] * 3
    assert hit("src/x.py") == [False, True, False] and hit("src/a/x.py") == [False] * 3
    assert hit("a/b/deep/x.log") == [False, False, True]


def test_search_and_budget(spark, built):
    found = search.resolve(built[0].nodes, "compute").collect()
    assert {r.id for r in found} == {"s:app/helpers.py#compute", "s:vendorlib/helpers.rb#compute"} and found[0].total == 2
    assert search.resolve(built[0].nodes, "app/main.py:run").first().id == "s:app/main.py#run"
    assert search.resolve(built[0].nodes, "%").count() == 0
    lines = spark.createDataFrame([(i, "x" * 40) for i in range(30)], "ord int, line string")
    assert search.budget_cut(lines, 100).count() == (100 - 12) // 11
    assert calls.GUESS_BELOW == 0.95


def test_commands(spark, built, tmp_path):
    from graphloom.operators import commands as c

    g = built[0]
    row = c.run(g, "who-calls", target="compute").plain()
    assert row["target"] == "s:app/helpers.py#compute" or row["ambiguous"] == 1
    done = c.run(g, "who-calls", target="app/helpers.py:compute", source=lambda p: TREE[p].encode())
    assert done.values["complete"] and done.values["total"] == 1 and "app/main.py:5 run  | return compute(2)" in done.text()
    assert c.code_lines(lambda p: b"x = 1\n" + b"y" * 200)("f", 2) == "y" * 99 + "…" and c.code_lines(None)("f", 1) == ""
    assert c.code_lines(lambda p: open("/nowhere/at/all", "rb").read())("f", 1) == ""
    opened = c.run(g, "who-calls", target="a.py:handle", source=lambda p: TREE[p].encode()).plain()["unresolved"]
    assert opened == [{"path": "c.py", "line": 2, "caller": "go", "code": "x.handle()"}]
    assert not c.run(g, "who-calls", target="a.py:handle").values["complete"]
    assert {r["id"] for r in c.run(g, "calls", target="run").plain()["callees"]} == {"s:app/helpers.py#compute"}
    assert {r["dst"] for r in c.run(g, "outline", target="app/main.py").plain()["imports"]} == {"f:app/helpers.py"}
    assert c.run(g, "impact", target="app/helpers.py:double").values["files"] >= 2
    assert c.run(g, "deps", target="app/main.py", transitive=True).values["total"] == 2
    assert c.run(g, "dependents", target="app/helpers.py").values["total"] == 1
    assert c.run(g, "neighbors", target="run", depth=1, kinds="calls").values["capped"] is False
    assert c.run(g, "subgraph", seeds=["run", "nothing at all"]).values["unresolved"] == ["nothing at all"]
    assert c.run(g, "find", target="save").values["total"] == 2
    assert c.run(g, "hubs").tables["functions"].count() > 0 and c.run(g, "cycles").values["count"] == 0
    seen = c.run(g, "overview")
    assert seen.values["files"] == 10 and len(seen.text(200)) / 4 <= 220
    shown = c.run(g, "span", target="app/helpers.py:double", source=lambda p: TREE[p].encode())
    assert shown.values["start"] == 8 and not shown.values["stale"]
    assert c.run(g, "span", target="app/helpers.py:double", source=lambda p: b"x\n" * 20).values["stale"]
    with pytest.raises(ValueError):
        c.run(g, "nope")
    with pytest.raises(c.NotFound):
        c.run(g, "calls", target="never heard of")


def test_a_cycle_is_found(spark, tmp_path):
    from graphloom.operators import commands as c

    g, _ = ix.index(spark, write(tmp_path, {"p.py": "import q\n", "q.py": "import r\n", "r.py": "import p\n", "s.py": "import p\n"}))
    assert [r["members"] for r in c.run(g, "cycles").plain()["cycles"]] == [["f:p.py", "f:q.py", "f:r.py"]]
