"""Import resolution: ordered candidates looked up by equi-joins, ambiguity rejected.

imports: path, raw. files: path, lang. An import resolves to the first candidate that is a
file by exact key (full path first, then extensionless or dotted path of the first file
by path, then package directory), is not the importer and speaks a compatible language; else, for
dotted names, to the only file that ends in them; else to the only file of that base name;
else to a library by name. Relative imports never go past the first step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname, library_name, normalised

#: Languages that import one another.
FAMILIES = {"c": "c", "cpp": "c", "javascript": "js", "typescript": "js", "java": "jvm", "kotlin": "jvm", "scala": "jvm"}
#: Files that stand for their directory.
PACKAGES = r"/(__init__\.pyi?|index\.(js|ts|jsx|tsx)|mod\.rs)$"


def family(lang):
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(F.element_at(table, lang), lang)


def keys(files: DataFrame) -> DataFrame:
    """key, kind (exact, suffix, base), prio and the file each names."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    package = F.when(F.col("path").rlike(PACKAGES), dirname(F.col("path")))
    parts = F.split(stem, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    base = files.withColumn("fam", family(F.col("lang")))
    row = lambda key, kind, prio: F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.lit(prio).alias("prio"))
    exact = [row(F.col("path"), "exact", 0), row(stem, "exact", 1), row(F.regexp_replace(stem, "/", "."), "exact", 1), row(package, "exact", 2), row(basename(stem), "base", 0), row(basename(package), "base", 0)]
    plain = base.select(F.col("path").alias("file"), "fam", F.explode(F.array(*exact)).alias("k"))
    suffix = base.select(F.col("path").alias("file"), "fam", F.explode(F.transform(tails, lambda t: row(t, "suffix", 0))).alias("k"))
    return plain.unionByName(suffix).select("file", "fam", "k.*").filter("key is not null and key <> ''").distinct()


def _merged_keys(files: DataFrame) -> DataFrame:
    """kind, key, fam and what they name: file and prio of exact keys; n, lo and hi, the count and the ends, of the files of loose ones."""
    known = keys(files)
    exact = known.filter("kind = 'exact'").select("kind", "key", "fam", "prio", "file", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"))
    loose = known.filter("kind <> 'exact'").groupBy("kind", "key", "fam").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("lo"), F.max("file").alias("hi"))
    return exact.unionByName(loose, allowMissingColumns=True)


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, raw, resolved (a file) and library of every distinct import; with a column lang, of its file, rows are distinct already.

    What an import may mean is looked up once for its folder and language. Only the file that asks
    is told apart later: the first two of the files that exact keys name, and count, first and last of
    those that a loose key names, say what is left without it.
    """
    if "lang" in imports.columns:
        asking = imports.select("path", "raw", family(F.col("lang")).alias("own"))
    else:
        asking = imports.select("path", "raw").distinct().join(files.select("path", family(F.col("lang")).alias("own")), "path", "left")
    asking = asking.select("path", "raw", dirname(F.col("path")).alias("dir"), F.coalesce(F.concat(F.lit("="), "own"), F.lit("")).alias("own"))
    asked = asking.select("dir", "raw", "own").distinct().withColumn("imp", F.trim("raw"))
    asked = asked.withColumn("level", F.length(F.regexp_extract("imp", r"^(\.*)", 1))).withColumn("name", F.regexp_replace("imp", r"^\.+", "")).filter("name <> ''")
    here = F.col("imp").rlike(r"^\.{1,2}/")
    up = F.when((F.col("level") > 0) & ~here, F.concat("dir", F.repeat(F.lit("/.."), F.greatest(F.col("level") - 1, F.lit(0))))).otherwise(F.col("dir"))
    dotted = F.regexp_replace("name", r"\.", "/")
    at = lambda x: normalised(F.concat_ws("/", up, x))
    plain = F.when(here, F.array(at(F.col("imp")))).when(F.col("level") > 0, F.array(at(dotted))).otherwise(F.array(at(F.col("name")), at(dotted), F.col("name"), dotted))
    tries = F.transform(plain, lambda key, pos: F.struct(F.lit("exact").alias("kind"), pos.alias("pos"), key.alias("key")))
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("pos"), key.alias("key"))
    loose = F.when(F.instr("name", ".") > 0, row("suffix", dotted)).otherwise(row("base", basename(F.col("name"))))
    tried = asked.select("dir", "raw", "own", F.explode(F.when(F.col("level") == 0, F.concat(tries, F.array(loose))).otherwise(tries)).alias("t")).select("dir", "raw", "own", "t.*")
    fits = F.col("fam").isNull() | (F.col("own") == "") | (F.concat(F.lit("="), "fam") == F.col("own"))
    best = F.collect_set(F.when(F.col("kind") == "exact", F.struct("pos", "prio", "file")))
    answers = tried.join(_merged_keys(files), ["kind", "key"]).filter(fits).groupBy("dir", "raw", "own").agg(best.alias("best"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    answers = answers.select("dir", "raw", "own", F.slice(F.array_distinct(F.transform(F.array_sort("best"), lambda b: b["file"])), 1, 2).alias("best"), "n", "lo", "hi")
    joined = asking.join(answers, ["dir", "raw", "own"], "left")
    other = lambda one, two: F.when(one != F.col("path"), one).otherwise(two)
    only = F.when(F.col("n") == 1, other(F.col("lo"), F.lit(None))).when((F.col("n") == 2) & (F.col("lo") == F.col("path")), F.col("hi")).when((F.col("n") == 2) & (F.col("hi") == F.col("path")), F.col("lo"))
    resolved = F.coalesce(other(F.get("best", F.lit(0)), F.get("best", F.lit(1))), only)
    found = joined.select("path", "raw", resolved.alias("resolved"))
    return found.select("path", "raw", "resolved", F.when(F.col("resolved").isNull() & ~F.trim("raw").startswith("."), library_name(F.col("raw"))).alias("library"))
