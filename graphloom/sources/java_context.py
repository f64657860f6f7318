"""What the Java compiler must see of other files: their declarations, found by the names that a file mentions.

A batch of files is attributed by itself; what lies in other batches, or in files that an edit
left alone, comes along as headers: the text without comments and method bodies, every
declaration on its own line. Which headers a batch needs follows from equi-joins of mentioned
names with declared ones, taken on from header to header until nothing new is met, so that the
batch sees what it would see beside the whole tree. A group then holds its batch and the
headers it reaches, at most those of the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import discard, durable

_PACKAGE = re.compile(r"^\s*package\s+([\w.$]+)\s*;", re.M)
_STAR = re.compile(r"\bimport\s+(?:static\s+)?([\w.$]+)\s*\.\s*\*")
_CHAIN = re.compile(r"[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*")
_TYPE = re.compile(r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"#\s*(?:throws\s[\w\s.,$@]+)?$")
_BRACE, _MARK, _ROUND = re.compile(r"[{}]"), re.compile(r"[{}();]"), re.compile(r"\([^()]*\)")
_PAIRS = "array<struct<package:string,name:string>>"
SURFACE = f"path string, package string, types array<string>, header string, uses {_PAIRS}, header_uses {_PAIRS}"


def _end(clean: str, at: int) -> int:
    """The place of the brace that closes the one at a place; the end of the text for none."""
    depth = 0
    for m in _BRACE.finditer(clean, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(clean)


def bodies(clean: str) -> list[tuple[int, int]]:
    """From where to where the insides of method bodies go, in a text without comments and strings."""
    found, start, round_, at = [], 0, 0, 0
    while m := _MARK.search(clean, at):
        at = m.end()
        if m[0] in "()":
            round_ = max(0, round_ + (1 if m[0] == "(" else -1))
        elif m[0] == "{":
            outside, inner = clean[start : m.start()], 1
            while inner:  # what stands in parentheses shrinks to #, which Java does not use
                outside, inner = _ROUND.subn("#", outside)
            if round_ == 0 and "=" not in outside and _TYPE.search(outside):
                start = at
                continue
            close = _end(clean, m.start())
            if round_ == 0 and "=" not in outside and _METHOD.search(outside):
                found.append((at, close))
            if round_ == 0 and "=" not in outside:
                start = close + 1
            at = close + 1
        elif round_ == 0:
            start = at
    return found


def header(text: str, clean: str) -> str:
    """A text without the insides of method bodies, all lines kept."""
    out, last = [], 0
    for begin, end in bodies(clean):
        out += [text[last:begin], "\n" * text.count("\n", begin, end)]
        last = end
    return re.sub(r"[ \t]{2,}", " ", "".join([*out, text[last:]]))


def mentions(package: str, clean: str) -> list[tuple[str, str]]:
    """package and name of every type that a text might mean by its words: of its own package, of imported ones, by full names."""
    places = sorted({package, *_STAR.findall(clean)})
    found = set()
    for chain in {re.sub(r"\s+", "", c) for c in _CHAIN.findall(clean)}:
        parts = chain.split(".")
        found.update((place, parts[0]) for place in places)
        found.update((".".join(parts[:i]), parts[i]) for i in range(1, len(parts)))
    return sorted(found)


def surface_of(path: str, commentless: str, clean: str) -> dict:
    """The row of SURFACE of one file."""
    named = _PACKAGE.search(clean)
    package = named[1] if named else ""
    short = header(clean, clean)
    pairs = lambda t: [{"package": p, "name": n} for p, n in mentions(package, t)]
    return {"path": path, "package": package, "types": sorted(set(_TYPE.findall(clean))), "header": header(commentless, clean), "uses": pairs(clean), "header_uses": pairs(short)}


def surface(java: DataFrame, blanked) -> DataFrame:
    """SURFACE of Java files (path, content), written; blanked: a text to itself without comments, and without strings too."""
    schema = java.sparkSession.createDataFrame([], SURFACE).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows.append(surface_of(r["path"], *blanked(r["content"].decode("utf-8", "ignore"))))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return durable(java.select("path", "content").mapInArrow(run, SURFACE), "java-surface")


def links(surfaces: DataFrame, column: str) -> DataFrame:
    """path and dst: the files that declare a type which the names in a column may mean."""
    declared = surfaces.select(F.col("path").alias("dst"), "package", F.explode("types").alias("name"))
    asked = surfaces.select("path", F.explode(column).alias("u")).select("path", "u.package", "u.name")
    return asked.join(declared, ["package", "name"]).filter("path <> dst").select("path", "dst").distinct()


def _closed(first: DataFrame, step, keys: list[str]) -> DataFrame:
    """All rows that step reaches from the first ones, in rounds until none is new; every round is written."""
    seen = frontier = durable(first, "java-reach")
    rounds = [frontier]
    while not frontier.isEmpty():
        frontier = durable(step(frontier).distinct().join(seen, keys, "left_anti"), "java-reach")
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
    whole = durable(seen, "java-closure")
    discard(*rounds)
    return whole


def needed(surfaces: DataFrame, dealt: DataFrame) -> DataFrame:
    """batch, path and header of every file outside a batch that its files (path, batch) may depend on."""
    uses, deeper = links(surfaces, "uses"), durable(links(surfaces, "header_uses"), "java-links")
    foreign = lambda found: found.join(dealt, ["batch", "path"], "left_anti")
    first = foreign(dealt.join(uses, "path").select("batch", F.col("dst").alias("path")).distinct())
    reached = _closed(first, lambda front: foreign(front.join(deeper, "path").select("batch", F.col("dst").alias("path"))), ["batch", "path"])
    discard(deeper)
    return reached.join(surfaces.select("path", "header"), "path")


def dependents(surfaces: DataFrame, touched: DataFrame, gone: DataFrame) -> DataFrame:
    """path of every file that may read otherwise now that the touched ones (path) have changed and types (name) are gone."""
    lost = gone.select("name").distinct()
    named = lambda column: surfaces.select("path", F.explode(column).alias("u")).select("path", "u.name").join(lost, "name", "left_semi").select("path")
    deeper = durable(links(surfaces, "header_uses"), "java-links")
    moved = _closed(touched.select("path").union(named("header_uses")).distinct(), lambda front: front.withColumnRenamed("path", "dst").join(deeper, "dst").select("path"), ["path"])
    discard(deeper)
    return links(surfaces, "uses").join(moved.withColumnRenamed("path", "dst"), "dst", "left_semi").select("path").union(named("uses")).union(moved).distinct()
