"""Discovery of a source tree: files as rows, dropped by rules over their directories.

The tree is one DataFrame of (path, length, content) that tasks read; every rule is a join
or a predicate on relative paths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname
from graphloom.sources.languages import CONFIG_EXTENSIONS, DOC_EXTENSIONS, EXTENSIONS, SKIPPED_SUFFIXES

MAX_FILE_BYTES = 1_200_000
#: Directories that never hold a project's own sources (those with a leading dot go anyway).
IGNORED_DIRS = ("node_modules", "__pycache__", "site-packages", "Pods", "bower_components", "jspm_packages")
#: Build output if a manifest lies beside it.
BUILD_DIRS = ("build", "out", "bin", "obj", "target", "dist", "coverage", "vendor")
MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "Makefile", "makefile", "package.json", "Cargo.toml", "go.mod", "build.sbt", "CMakeLists.txt", "meson.build")
ENV_DIRS = ("env", "venv", ".venv")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length and content of every file below root, a folder that all workers see.

    Spark's own file sources pass over names that begin with a dot or an underscore, so tasks
    walk the folders below root, ignored ones left out, and read the contents. A file that is
    reached by several paths counts once, by the first of them. Linked folders are not entered.
    """
    root = re.sub(r"^file:/*", "/", root).rstrip("/")
    kept = lambda names: sorted(d for d in names if d not in IGNORED_DIRS and not d.startswith("."))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column("folder").to_pylist()):
            found = []
            for here, dirs, names in os.walk(os.path.join(root, folder)):
                dirs[:] = kept(dirs) if folder else []
                for at in (os.path.join(here, name) for name in names):
                    if os.path.isfile(at):
                        found.append((os.path.relpath(at, root).replace(os.sep, "/"), os.path.realpath(at), os.path.getsize(at)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["path", "real", "length"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                if length <= MAX_FILE_BYTES:
                    with open(f"{root}/{path}", "rb") as file:
                        yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "content": [file.read()]})

    # the driver lists the first level only; "" stands for the files of the root itself
    top = ["", *kept(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False))]
    folders = spark.createDataFrame([(f,) for f in top], "folder string").repartition(max(1, min(len(top), 256)))
    listed = folders.mapInArrow(walked, "path string, real string, length long").groupBy("real").agg(F.min(F.struct("path", "length")).alias("first"))
    return listed.select("first.path", "first.length").mapInArrow(contents, "path string, length long, content binary")


def above(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def ignored_dir(path: Column) -> Column:
    """Whether a directory above has a name that is always ignored, or a leading dot."""
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.isin(*IGNORED_DIRS) | d.startswith("."))


def output_dirs(files: DataFrame) -> DataFrame:
    """dir: build output beside a manifest, and virtual environments."""
    manifests = files.filter(basename(F.col("path")).isin(*MANIFESTS)).select(dirname(F.col("path")).alias("home")).distinct()
    dirs = files.select(F.explode(above(F.col("path"))).alias("dir")).distinct()
    built = dirs.filter(basename(F.col("dir")).isin(*BUILD_DIRS)).withColumn("home", dirname(F.col("dir"))).join(manifests, "home", "left_semi").select("dir")
    envs = files.filter(basename(F.col("path")) == "pyvenv.cfg").select(dirname(F.col("path")).alias("dir")).filter(basename(F.col("dir")).isin(*ENV_DIRS))
    return built.union(envs).distinct()


def glob_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression over a relative path."""
    out, i = "", 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest.startswith("**"):
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (m := re.match(r"\[(!?)([^\]]+)\]", rest)):
            out, i = out + f"[{'^' if m[1] else ''}{m[2]}]", i + m.end()
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def ignore_rules(base: str, text: str) -> list[tuple[str, int, str, bool, bool]]:
    """base, ord, regex, negate and dir_only of the rules of one .gitignore."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        pattern = line[1:] if negate else line.removeprefix("\\")
        dir_only, pattern = pattern.endswith("/"), pattern.rstrip("/")
        anchored, pattern = "/" in pattern, pattern.lstrip("/")
        regex = f"^{'' if anchored else '(?:.*/)?'}{glob_regex(pattern)}$"
        rules.append((base, len(rules), regex, negate, dir_only))
    return rules


def ignored(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path of every file that the .gitignore files of the tree ignore.

    For each path and each directory above it the last rule that matches decides, deeper
    files after shallower ones; a path is ignored if it or any directory above is. Rules meet
    the paths below their directory by an equi-join on that directory.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("base", "ord", "regex", "negate", "dir_only")
        for batch in batches:
            rules = [r for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True) for r in ignore_rules(path.rpartition("/")[0], content.decode("utf-8", "replace"))]
            if rules:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rules, strict=True), (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=list(names))

    table = files.filter(basename(F.col("path")) == ".gitignore").select("path", "content").mapInArrow(parsed, "base string, ord int, regex string, negate boolean, dir_only boolean")
    parts = files.select("path", F.explode(F.concat(above(F.col("path")), F.array("path"))).alias("at"))
    inside = parts.select("path", "at", F.explode(F.concat(F.array(F.lit("")), above(F.col("at")))).alias("base")).join(table, "base")
    tail = F.when(F.col("base") == "", F.col("at")).otherwise(F.expr("substring(at, length(base) + 2)"))
    hit = inside.filter(F.rlike(tail, F.col("regex")) & (~F.col("dir_only") | (F.col("at") != F.col("path"))))
    last = hit.groupBy("path", "at").agg(F.max_by("negate", F.struct(F.length("base"), "ord")).alias("negate"))
    return last.filter(~F.col("negate")).select("path").distinct()


def language(path: Column) -> Column:
    """lang of a path by its extension; null for what is skipped or unknown."""
    extension = F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    skipped = F.lit(False)
    for suffix in SKIPPED_SUFFIXES:
        skipped = skipped | F.lower(path).endswith(suffix)
    low = F.lower(extension)
    code = F.when(~skipped, F.coalesce(F.element_at(table, extension), F.element_at(table, low)))
    return F.when(code.isNotNull(), code).when(low.isin(*DOC_EXTENSIONS), "markdown").when(low.isin(*CONFIG_EXTENSIONS), "config")


def selected(spark: SparkSession, tree: DataFrame, respect_gitignore: bool = True) -> DataFrame:
    """path, lang, kind (code, doc, config) and content of a project's files, of all files (path, length, content)."""
    listed = tree.filter(~ignored_dir(F.col("path")))
    out = output_dirs(listed.select("path")).withColumnRenamed("dir", "_dir")
    dropped = listed.select("path", F.explode(above(F.col("path"))).alias("_dir")).join(out, "_dir").select("path").distinct()
    kept = listed.join(dropped, "path", "left_anti")
    if respect_gitignore:
        kept = kept.join(ignored(spark, listed), "path", "left_anti")
    lang = language(F.col("path"))
    kind = F.when(F.col("lang") == "markdown", "doc").when(F.col("lang") == "config", "config").otherwise("code")
    return kept.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("lang", lang).filter("lang is not null").withColumn("kind", kind).select("path", "lang", "kind", "content")


def discover(spark: SparkSession, root: str, respect_gitignore: bool = True) -> DataFrame:
    """path, lang, kind and content of the files of a project below root."""
    return selected(spark, read_tree(spark, root), respect_gitignore)
