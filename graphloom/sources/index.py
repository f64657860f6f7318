"""The code graph of a tree: facts cached by content hash, nodes and edges rebuilt from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.durable import discard, durable, swept, together
from graphloom.functions.text import basename, dirname, duplicate_ids
from graphloom.operators import calls, graph
from graphloom.operators import imports as import_rules
from graphloom.sources import java_context, store
from graphloom.sources.parse import java_surface, parse
from graphloom.sources.scan import above, discover


@dataclass
class CodeGraph:
    """The tables of an index."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    imports: DataFrame
    unbound: DataFrame
    counters: DataFrame

    TABLES = ("files", "nodes", "edges", "imports", "unbound", "counters")

    #: Set where the graph is read from a store.
    lookup: store.Lookup | None = None

    def write(self, out: str, facts: DataFrame | None = None) -> None:
        """A new version of the stored graph, and of the facts it was made from; it is seen once it is whole."""

        def fill(folder: str) -> None:
            for name in self.TABLES:
                if name != "edges":
                    getattr(self, name).write.parquet(f"{folder}/{name}")
            store.Lookup.write(self.edges, folder)
            if facts is not None:
                facts.write.parquet(f"{folder}/facts")

        store.publish(self.nodes.sparkSession, out, fill)

    @classmethod
    def read(cls, spark: SparkSession, where: str) -> CodeGraph:
        """The newest whole version, to which the tables read stay pinned."""
        folder = store.current(spark, where)
        if folder is None:
            raise FileNotFoundError(f"no whole version of a graph in {where}")
        lookup = store.Lookup.read(spark, folder)
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in cls.TABLES if name != "edges"}
        return cls(**tables, edges=lookup.out.drop("bucket"), lookup=lookup)

    def near(self, end: str, ids: list[str], kinds: list[str] | None = None) -> DataFrame:
        """The edges whose end, src or dst, is one of the ids: a lookup where the graph is stored."""
        found = self.lookup.near(end, ids) if self.lookup else self.edges.filter(F.col(end).isin(ids))
        return graph.of_kinds(found, kinds)


def symbol_rows(facts: DataFrame) -> DataFrame:
    """id, owner (place in its file), path, name, kind, line, length, complexity, documented, parent, lang."""
    rows = facts.select("path", "lang", F.posexplode("symbols").alias("owner", "s")).select("path", "lang", "owner", "s.*")
    # bodies stay where they are; their digests go round
    return rows.withColumn("body", F.sha1("body")).withColumn("id", duplicate_ids("path", "name", "body")).drop("body")


def scope_targets(facts: DataFrame, symbols: DataFrame, resolve) -> DataFrame:
    """path, owner, line, name, scope_dst and module_external of sites whose names a scope binds.

    Candidates are tried in order: the module's file (the own file for none) must define the
    name, in the class if one is given, else preferably at top level.
    """
    site = facts.select("path", F.posexplode("refs").alias("site", "r")).select("path", "site", F.posexplode("r.cands").alias("pos", "c")).select("path", "site", "pos", "c.*")
    modules = resolve(site.filter("mod <> ''").select("path", F.col("mod").alias("raw")).distinct())
    found = site.join(modules.select("path", F.col("raw").alias("mod"), "resolved"), ["path", "mod"], "left").withColumn("file", F.when(F.col("mod") == "", F.col("path")).otherwise(F.col("resolved")))
    defs = symbols.select(F.col("path").alias("file"), "name", F.col("parent").alias("own"), F.col("id").alias("dst"))
    hit = found.join(defs, ["file", "name"]).filter((F.col("cls") == "") | (F.col("own") == F.col("cls")))
    best = hit.groupBy("path", "site").agg(F.min(F.struct("pos", F.when((F.col("cls") == "") & F.col("own").isNotNull(), 1).otherwise(0).alias("nested"), "dst")).alias("b")).select("path", "site", F.col("b.dst").alias("scope_dst"))
    outside = found.groupBy("path", "site").agg(F.bool_and(F.col("file").isNull()).alias("module_external"))
    return outside.join(best, ["path", "site"], "left")


#: Call sites that are resolved at once, and the most slices that a tree is cut into for it.
SLICE_SITES, MOST_SLICES = 1_000_000, 16


def parted(rows: int, number: Callable[[Column], Column] = F.xxhash64) -> list[Callable[[Column], Column]]:
    """Conditions on a key that part a table, as many as its rows ask for; number: what keys are dealt by."""
    n = max(1, min(MOST_SLICES, -(-rows // SLICE_SITES)))
    return [lambda c, i=i: F.pmod(number(c), F.lit(n)) == i for i in range(n)] if n > 1 else [lambda c: F.lit(True)]


@dataclass
class Sites:
    """How many call sites a tree has, imports of its files, sites with a receiver or a place, and sites that a scope may bind."""

    all: int
    imports: int
    special: int
    scoped: int

    @classmethod
    def of(cls, facts: DataFrame) -> Sites:
        special = F.filter("refs", lambda r: F.coalesce(r["recv"] != "", F.lit(False)) | F.coalesce(r["tag"] == "at", F.lit(False)))
        numbers = {"all": "refs", "imports": "imports", "special": special, "scoped": F.filter("refs", lambda r: F.size(r["cands"]) > 0)}
        return cls(**facts.agg(*(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(name) for name, c in numbers.items())).first().asDict())


def _slices(facts: DataFrame, sites: Sites | None = None) -> list[Callable[[Column], Column]]:
    """Conditions on a path or an id that part the files and nodes of a tree, as many as its call sites ask for."""
    return parted((sites or Sites.of(facts)).all)


RESOLVED = "sym string, path string, name string, line int, verdict string, dst string, conf double"


def call_sites(facts: DataFrame, symbols: DataFrame, found: DataFrame, code: DataFrame, within: Callable[[Column], Column], number: Sites, every: DataFrame, local: DataFrame) -> DataFrame:
    """The resolved call sites of the files whose path lies within a slice, written; symbols, imports found and code (path, lang) are of all files.

    every, local: calls.everywhere() and calls.here() of all symbols, written.
    """
    facts, own, found = (df.filter(within(F.col("path"))) for df in (facts, symbols, found))
    fid = lambda c: F.concat(F.lit("f:"), c)
    # what a file's sites need of their file is joined to the file, not to its sites, of which there are many more
    owners = own.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("owner", "id"))), lambda o: o["id"]).alias("owners"))
    around = facts.select("path", "refs").join(owners, "path", "left")
    if number.scoped:
        scoped = scope_targets(facts, symbols, lambda asked: import_rules.resolve(asked, code)).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("site", F.struct("scope_dst", "module_external")))).alias("scoped"))
        around = around.join(scoped, "path", "left")
    else:
        around = around.withColumn("scoped", F.lit(None).cast("map<int,struct<scope_dst:string,module_external:boolean>>"))
    sites = around.select("path", "owners", "scoped", F.posexplode("refs").alias("site", "r"))
    bound = F.try_element_at("scoped", F.col("site"))
    refs = sites.select(F.coalesce(F.get("owners", F.col("r.owner")), fid(F.col("path"))).alias("sym"), "path", "r.name", "r.is_method", "r.recv", "r.line", F.when(F.col("r.tag").isNotNull(), F.struct(F.col("r.tag").alias("tag"), F.col("r.tpath").alias("path"), F.col("r.tline").alias("line"), F.lit(None).cast("array<struct<mod:string,cls:string,name:string>>").alias("cands"))).alias("target"), bound["scope_dst"].alias("scope_dst"), bound["module_external"].alias("module_external"))
    deps = found.filter("resolved is not null").select("path", "raw", F.col("resolved").alias("dep"))
    if number.special:
        # what a receiver may stand for
        names = F.array(F.regexp_replace(basename(F.col("dep")), r"\.[^.]*$", ""), F.element_at(F.split("raw", r"[./:\\]+"), -1))
        deps = facts.select("path", F.posexplode("imports").alias("ord", "raw")).join(deps, ["path", "raw"]).select("path", "dep", "ord", F.explode(F.array_distinct(names)).alias("alias"))
    asked = facts.select("path", F.explode(F.array_distinct("refs.name")).alias("name"))
    seen = swept(durable(calls.through_imports(asked, symbols, deps, local), "seen"))
    resolved = swept(durable(calls.resolve(refs, symbols, deps, seen, every, local.filter(within(F.col("path"))) if not number.special else local, not number.special).select("sym", "path", "name", "line", "verdict", "dst", "conf"), "calls"))
    discard(seen)
    return resolved


def outside(facts: DataFrame) -> DataFrame:
    """Facts with those call sites alone that stand outside of all symbols.

    A graph made of them has all files, symbols, imports and containment, and the degrees of
    files, folders and libraries are as in the whole graph, as only symbols are called.
    """
    return facts.withColumn("refs", F.filter("refs", lambda r: r["owner"] < 0))


def build(facts: DataFrame) -> CodeGraph:
    """Nodes, edges and open call sites from the facts of all files.

    What is shuffled for a call site is many times what is kept of it, so large trees are resolved
    slice by slice of their files; shuffle files of one slice are swept before the next begins, and
    its sites are deleted once their edges, open sites and counts are written.
    """
    files = facts.drop("symbols", "refs", "imports")
    code = files.select("path", "lang")
    symbols = durable(symbol_rows(facts), "symbols")
    number = Sites.of(facts)
    slices, even = _slices(facts, number), parted(max(number.all, number.imports))
    raw = facts.select("path", "lang", F.explode(F.array_distinct("imports")).alias("raw"))
    found = together([swept(durable(import_rules.resolve(raw.filter(within(F.col("path"))), code), "imports")) for within in parted(number.imports)])
    dirs = files.select(F.explode(F.concat(F.array(F.lit(".")), above(F.col("path")))).alias("path")).distinct()
    fid = lambda c: F.concat(F.lit("f:"), c)
    none = lambda kind: F.lit(None).cast(kind)
    shape = ["id", "kind", "name", "path", "line", "length", "complexity", "documented", "lang", "parent"]
    nodes = (
        dirs.select(F.concat(F.lit("d:"), "path").alias("id"), F.lit("Dir").alias("kind"), basename(F.col("path")).alias("name"), "path", none("int").alias("line"), none("int").alias("length"), none("int").alias("complexity"), none("boolean").alias("documented"), none("string").alias("lang"), none("string").alias("parent"))
        .unionByName(files.select(fid(F.col("path")).alias("id"), F.lit("File").alias("kind"), basename(F.col("path")).alias("name"), "path", none("int").alias("line"), F.col("loc").alias("length"), "complexity", none("boolean").alias("documented"), "lang", none("string").alias("parent")))
        .unionByName(symbols.select(*shape))
        .unionByName(found.filter("library is not null").select("library").distinct().select(F.concat(F.lit("lib:"), "library").alias("id"), F.lit("Library").alias("kind"), F.col("library").alias("name"), none("string").alias("path"), none("int").alias("line"), none("int").alias("length"), none("int").alias("complexity"), none("boolean").alias("documented"), none("string").alias("lang"), none("string").alias("parent")))
    )
    home = F.when(dirname(F.col("path")) == "", F.lit("d:.")).otherwise(F.concat(F.lit("d:"), dirname(F.col("path"))))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("conf"), none("array<int>").alias("lines"))
    contains = edge(dirs.filter("path <> '.'"), home, F.concat(F.lit("d:"), "path"), "contains").unionByName(edge(files, home, fid(F.col("path")), "contains")).unionByName(edge(symbols, fid(F.col("path")), F.col("id"), "contains"))
    imported = edge(found.filter("resolved is not null"), fid(F.col("path")), fid(F.col("resolved")), "imports").unionByName(edge(found.filter("library is not null"), fid(F.col("path")), F.concat(F.lit("lib:"), "library"), "imports"))

    plain = contains.unionByName(imported)
    linked = [swept(durable(plain.filter(within(F.col("src"))).dropDuplicates(["src", "dst", "kind"]), "edges")) for within in even]
    unbound, tallies, names = [], [], []
    if number.all:
        names = [durable(calls.everywhere(symbols), "names"), swept(durable(calls.here(symbols), "names-here"))]
    for within in slices:
        if number.all:
            resolved = call_sites(facts, symbols, found, code, within, number, *names)
        else:
            resolved = durable(facts.sparkSession.createDataFrame([], RESOLVED), "calls")
        # all calls of a symbol lie in the slice of its file
        linked.append(durable(calls.edges(resolved), "edges"))
        unbound.append(durable(calls.unbound(resolved), "unbound"))
        tallies.append(swept(durable(calls.tally(resolved), "tally")))
        discard(resolved)
    edges = together(linked)
    nodes = together([swept(durable(graph.degrees(nodes, edges, within), "nodes")) for within in even])
    discard(symbols, *names)
    return CodeGraph(files, nodes, edges, found, together(unbound), calls.covered(together(tallies)))


def split_changed(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cached facts of files whose content is as it was, and the files to parse.

    Files that are gone drop out, as only the present ones are asked for.
    """
    # hashes are written once, so that contents are read again only to be parsed
    now = durable(files.select("path", F.sha1("content").alias("hash")), "hashes")
    same = cached.join(now, ["path", "hash"], "left_semi")
    return same, files.join(now.join(same.select("path"), "path", "left_anti").select("path"), "path", "left_semi")


def reread(files: DataFrame, same: DataFrame, changed: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """same and changed, with unchanged Java files moved over that depend on what has changed, and the tree's Java surface.

    What the compiler bound holds places in other files, so those that reach a changed, new or
    deleted file by the types they mention are read again. Without such an edit nothing moves.
    """
    touched = durable(changed.filter("lang = 'java'").select("path"), "java-touched")
    kept = durable(same.filter("lang = 'java'").select("path"), "java-kept")
    before = cached.filter("lang = 'java'").join(kept, "path", "left_anti")
    lost = durable(before.select(F.explode("symbols").alias("s")).filter("s.kind = 'Class'").select("s.name").distinct(), "java-lost")
    if touched.isEmpty() and lost.isEmpty():
        return same, changed, None
    surfaces = java_surface(files)
    again = durable(java_context.dependents(surfaces, touched, lost).join(kept, "path", "left_semi"), "java-again")
    return same.join(again, "path", "left_anti"), changed.unionByName(files.select(*changed.columns).join(again, "path", "left_semi")), surfaces


def index(spark: SparkSession, root: str, respect_gitignore: bool = True, frontends: bool | tuple[str, ...] = True, cached: DataFrame | None = None) -> tuple[CodeGraph, DataFrame]:
    """The graph of a tree and its facts; facts of files whose content is unchanged come from `cached`.

    Hashes are compared before parsing, so an unchanged file costs no parse, but for Java files
    that depend on changed ones.
    """
    files = discover(spark, root, respect_gitignore)
    if cached is not None:
        same, changed = split_changed(files, cached)
        surfaces = None
        if frontends is True or "java" in tuple(frontends or ()):
            same, changed, surfaces = reread(files, same, changed, cached)
        facts = same.unionByName(parse(changed, frontends, root, surfaces))
    else:
        facts = parse(files, frontends, root)
    facts = durable(facts, "facts")
    return build(facts), facts
