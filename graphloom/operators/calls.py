"""Call resolution: a ladder of tiers, each an equi-join on pre-aggregated definitions.

refs: sym (the caller), path, name, is_method, recv, line, target (struct tag, path, line,
cands). symbols: id, path, name, line, parent, kind. imports: path, dep, alias (recv names
that stand for dep), and ord, by which the last import of an alias wins. Missing optional columns are filled with nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GUESS_BELOW = 0.95
TARGET = "struct<tag:string,path:string,line:int,cands:array<struct<mod:string,cls:string,name:string>>>"


def _with(df: DataFrame, **defaults: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in defaults.items() if c not in df.columns})


def here(symbols: DataFrame) -> DataFrame:
    """path, name, n_here and d_here: how many symbols of a file have a name, and the least id among them."""
    return symbols.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_here"), F.min("id").alias("d_here"))


def through_imports(refs: DataFrame, symbols: DataFrame | None, imports: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """path, name, n_seen and d_seen: the symbols of an asked name in the files that a file imports, 2 for any more than one.

    A file's names do not meet its imports one by one: the names that it asks for are intersected
    with all that the files have which it imports, what they share with those of each file, and
    that is counted where it is.
    local: here() of all symbols, if it is written.
    """
    local = here(symbols) if local is None else local
    want = refs.groupBy("path").agg(F.collect_set("name").alias("want"))
    have = local.groupBy(F.col("path").alias("dep")).agg(F.collect_list("name").alias("have"))
    around = imports.select("path", "dep").distinct().join(have, "dep").groupBy("path").agg(F.collect_list(F.struct("dep", "have")).alias("deps")).join(want, "path")
    met_ = F.array_intersect(F.flatten(F.transform("deps", lambda d: d["have"])), F.col("want"))
    shared = around.select("path", met_.alias("met"), "deps").select("path", "met", F.explode("deps").alias("d")).select("path", "d.dep", F.explode(F.array_intersect("met", "d.have")).alias("name"))
    met = shared.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_deps"), F.min("dep").alias("dep"))
    own = local.select(F.col("path").alias("dep"), "name", F.least("n_here", F.lit(2)).alias("n_here"), "d_here")
    alone = met.select("path", "name", "n_deps", F.when(F.col("n_deps") == 1, F.col("dep")).alias("dep"))
    return alone.join(own, ["dep", "name"], "left").select("path", "name", F.when(F.col("n_deps") == 1, F.col("n_here")).otherwise(2).alias("n_seen"), F.col("d_here").alias("d_seen"))


def everywhere(symbols: DataFrame) -> DataFrame:
    """name, n_all and d_all: how many symbols have a name, and the least id among them."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n_all"), F.min("id").alias("d_all"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, seen: DataFrame | None = None, every: DataFrame | None = None, local: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """Each ref with verdict (external, unresolved, ambiguous, bound), dst and conf.

    seen, every and local: through_imports(), everywhere() and here(), if they are written; plain:
    no ref has a receiver or a place that a compiler names.
    """
    refs = _with(refs, is_method="boolean", recv="string", target=TARGET, module="string", module_external="boolean", scope_dst=symbols.schema["id"].dataType.simpleString())
    every = everywhere(symbols) if every is None else every
    local = here(symbols) if local is None else local
    seen = through_imports(refs, symbols, imports) if seen is None else seen
    none = lambda df: df.withColumns({"n_mod": F.lit(None).cast("long"), "d_mod": F.col("d_all"), "d_at": F.lit(None).cast(symbols.schema["id"].dataType)})
    named = lambda df: df.join(every, "name", "left").join(local, ["path", "name"], "left").join(seen, ["path", "name"], "left")
    # sites without a receiver and a place, in most trees nearly all, do not go round for those
    special = F.lit(False)
    if "alias" in imports.columns and not plain:
        special = special | F.coalesce(F.col("recv") != "", F.lit(False))
    if "line" in symbols.columns and not plain:
        special = special | F.coalesce(F.col("target.tag") == "at", F.lit(False))
    found, some_ = none(named(refs.filter(~special))), refs.filter(special)
    if ("alias" in imports.columns or "line" in symbols.columns) and not plain:
        found = found.unionByName(_with_receivers(none(named(some_)), some_, symbols, local, imports))
    one, some = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)), lambda c: F.coalesce(F.col(c) > 1, F.lit(False))
    method = F.coalesce("is_method", F.lit(False))
    ladder = [
        (F.col("target.tag") == "ext", "external", None, None),
        (F.col("d_at").isNotNull(), "bound", "d_at", 1.00),
        (F.col("scope_dst").isNotNull(), "bound", "scope_dst", 0.97),
        (F.coalesce("module_external", F.lit(False)), "external", None, None),
        (F.col("n_all").isNull(), "unresolved", None, None),
        (one("n_mod"), "bound", "d_mod", 0.90),
        (method & one("n_all"), "bound", "d_all", 0.60),
        (method, "ambiguous", None, None),
        (one("n_here"), "bound", "d_here", 0.95),
        (some("n_here"), "ambiguous", None, None),
        (one("n_seen"), "bound", "d_seen", 0.80),
        (some("n_seen"), "ambiguous", None, None),
        (one("n_all"), "bound", "d_all", 0.60),
    ]

    def choose(pick, last: Column) -> Column:
        out = None
        for rung in ladder:
            out = F.when(rung[0], pick(rung)) if out is None else out.when(rung[0], pick(rung))
        return out.otherwise(last)

    null = F.lit(None)
    return found.withColumn("verdict", choose(lambda r: F.lit(r[1]), F.lit("ambiguous"))).withColumn("dst", choose(lambda r: F.col(r[2]) if r[2] else null, null)).withColumn("conf", choose(lambda r: F.lit(r[3]) if r[3] else null, null).cast("double")).select(*refs.columns, "verdict", "dst", "conf")


def _with_receivers(found: DataFrame, refs: DataFrame, symbols: DataFrame, local: DataFrame, imports: DataFrame) -> DataFrame:
    """found, which is refs and more, with what a receiver's module defines (n_mod, d_mod) and what lies at a place that a compiler names (d_at)."""
    columns = found.columns
    if "alias" in imports.columns:
        last = _with(imports, ord="int").filter("alias is not null").groupBy("path", "alias").agg(F.max(F.struct("ord", "dep")).alias("last"))
        alias = last.select("path", F.col("alias").alias("recv"), F.col("last.dep").alias("dep"))
        through = refs.select("path", "name", "recv").filter("recv <> ''").distinct().join(alias, ["path", "recv"]).join(local.select(F.col("path").alias("dep"), "name", "n_here", "d_here"), ["dep", "name"]).groupBy("path", "name", "recv").agg(F.sum("n_here").alias("n_mod"), F.min("d_here").alias("d_mod"))
        found = found.drop("n_mod", "d_mod").join(through, ["path", "name", "recv"], "left")
    if "line" in symbols.columns:
        at = refs.filter("target.tag = 'at'").select(F.col("target.path").alias("tp"), F.col("target.line").alias("tl"), "name").distinct()
        near = nearest(at, symbols)
        found = found.drop("d_at").join(near.select(F.col("tp").alias("_tp"), F.col("tl").alias("_tl"), F.col("name").alias("_n"), "d_at"), (F.col("target.path") == F.col("_tp")) & (F.col("target.line") == F.col("_tl")) & (F.col("name") == F.col("_n")), "left")
    return found.select(*columns)


#: Symbols that one task is given to look for the nearest among.
PART_SYMBOLS = 200_000


def nearest(at: DataFrame, symbols: DataFrame) -> DataFrame:
    """tp, tl, name and d_at: the symbol of that name in file tp that lies nearest to line tl.

    Ties go to the lesser line, then to the least id; a symbol without a line comes last, and to a
    null tl the first line is nearest. Lines and symbols of a file and name are put in one order,
    once from either end, and each line takes the last symbol before it: no line meets all symbols.
    """
    kinds = symbols.select(F.col("line").alias("_line"), "id").schema
    kind = lambda c: kinds[c].dataType
    asked = at.select("tp", "name", "tl", F.lit(None).cast(kind("_line")).alias("_line"), F.lit(None).cast(kind("id")).alias("id"), F.lit(True).alias("_asked")).distinct()
    known = symbols.select(F.col("path").alias("tp"), "name", F.lit(None).cast(at.schema["tl"].dataType).alias("tl"), F.col("line").alias("_line"), "id", F.lit(False).alias("_asked")).filter("tp is not null and name is not null")
    both = asked.unionByName(known)
    # as many tasks as the symbols need, so that what one of them sorts does not grow with the tables
    parts = symbols.count() // PART_SYMBOLS
    if parts >= int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(parts + 1, "tp", "name")
    place = F.when(F.col("_asked"), F.col("tl")).otherwise(F.col("_line"))
    # a line that is not told stands before all others, a symbol without a line behind them
    rank = F.when(place.isNotNull(), 1).when(F.col("_asked"), 0).otherwise(2)
    found = F.last(F.when(~F.col("_asked"), F.struct("_line", "id")), ignorenulls=True)
    from_first = Window.partitionBy("tp", "name").orderBy(rank, place, F.desc("id"), "_asked")
    from_last = Window.partitionBy("tp", "name").orderBy(F.desc(rank), F.desc(place), F.desc("id"), "_asked")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.withColumn("_before", found.over(ahead(from_first))).withColumn("_after", found.over(ahead(from_last))).filter("_asked")
    off = lambda c: F.abs(F.col(f"{c}._line") - F.col("tl"))
    first = F.col("_before.id").isNotNull() & (F.col("_after._line").isNull() | (off("_before") <= off("_after")))
    return ends.select("tp", "tl", "name", F.when(first, F.col("_before.id")).otherwise(F.col("_after.id")).alias("d_at")).filter("d_at is not null")


def edges(resolved: DataFrame) -> DataFrame:
    """src, dst, kind, conf (best) and lines (sorted set) of bound calls, without self-calls."""
    bound = resolved.filter("verdict = 'bound'").filter(F.col("sym") != F.col("dst"))
    return bound.groupBy(F.col("sym").alias("src"), "dst").agg(F.max("conf").alias("conf"), F.array_sort(F.collect_set("line")).alias("lines")).withColumn("kind", F.lit("calls"))


def unbound(resolved: DataFrame) -> DataFrame:
    """name, src, path and line of the call sites that could mean several symbols."""
    return resolved.filter("verdict = 'ambiguous'").select("name", F.col("sym").alias("src"), "path", "line")


def tally(resolved: DataFrame) -> DataFrame:
    """One row: how many sites each verdict has, and how many a compiler has bound."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return resolved.agg(*map(count, ("external", "unresolved", "ambiguous", "bound")), F.count_if(F.col("conf") == 1.0).alias("compiled"))


def covered(tallies: DataFrame) -> DataFrame:
    """The rows of tally() as one, and the covered percentage."""
    row = tallies.agg(*(F.sum(c).alias(c) for c in tallies.columns))
    return row.withColumn("coverage", F.call_function("div", 100 * F.col("bound"), F.greatest(F.col("bound") + F.col("ambiguous"), F.lit(1))))


def counters(resolved: DataFrame) -> DataFrame:
    """One row: how many sites each verdict has, and the covered percentage."""
    return covered(tally(resolved))


def callers_verdict(call_edges: DataFrame, open_sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, callers, sites, guesses, unresolved and complete of every symbol that is called or might be."""
    called = call_edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.sum(F.size("lines")).alias("sites"), F.count_if(F.col("conf") < GUESS_BELOW).alias("guesses"))
    left = open_sites.groupBy("name").agg(F.count(F.lit(1)).alias("unresolved"))
    joined = symbols.select("id", "name").join(called, "id", "left").join(left, "name", "left").fillna(0, ["callers", "sites", "guesses", "unresolved"])
    return joined.filter("callers > 0 or unresolved > 0").withColumn("complete", (F.col("guesses") == 0) & (F.col("unresolved") == 0) & (F.col("callers") <= 500))
