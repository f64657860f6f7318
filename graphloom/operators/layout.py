"""Positions of a drawn graph: a flat one of shelves and grids, and a spatial one of clouds; the same for the same input."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP = 1.0
#: How far modules spread in space, and the clouds of files in a module and of symbols in a file.
SPREAD, FILE_CLOUD, SYMBOL_CLOUD = 172.0, (12.0, 4.6), (5.0, 2.6)
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
AXES = ("x", "y", "z")


def grid(nodes: DataFrame, module: str = "module") -> DataFrame:
    """column and row of each node in the near-square grid of its module, by descending degree."""
    order = Window.partitionBy(module).orderBy(F.desc("degree"), "id")
    count = F.count(F.lit(1)).over(Window.partitionBy(module))
    placed = nodes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.ceil(F.sqrt(count.cast("double"))).cast("int"))
    return placed.withColumn("column", F.col("_i") % F.col("_w")).withColumn("row", F.floor(F.col("_i") / F.col("_w")).cast("int")).drop("_i", "_w")


def shelves(sizes: list[tuple[str, float]]) -> dict[str, tuple[float, float]]:
    """Left and top of squares (name, side) packed on shelves, large ones first."""
    width = max([s for _, s in sizes], default=0) if len(sizes) < 2 else max(max(s for _, s in sizes), np.sqrt(sum((s + GAP) ** 2 for _, s in sizes)) * 1.3)
    out, x, y, height = {}, 0.0, 0.0, 0.0
    for name, side in sorted(sizes, key=lambda p: (-p[1], p[0])):
        if x and x + side > width:
            x, y, height = 0.0, y + height + GAP, 0.0
        out[name] = (float(x), float(y))
        x, height = x + side + GAP, max(height, side)
    return out


def atlas(nodes: DataFrame, module: str = "module") -> DataFrame:
    """x and y of every node: its module's place on the shelves plus its place in the grid.

    Only one row per module meets on the driver, and the drawing bounds their number.
    """
    sides = nodes.groupBy(module).agg(F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).alias("side")).collect()
    spots = shelves([(str(r[module]), float(r["side"])) for r in sides])
    table = nodes.sparkSession.createDataFrame([(k, *v) for k, v in spots.items()] or [("", 0.0, 0.0)], "_m string, _x double, _y double")
    placed = grid(nodes, module).join(F.broadcast(table), F.col(module).cast("string") == F.col("_m"))
    return placed.withColumn("x", F.col("_x") + F.col("column")).withColumn("y", F.col("_y") + F.col("row")).drop("_m", "_x", "_y", "column", "row")


def force(names: list[str], links: list[tuple[str, str, float]], steps: int = 80, seed: int = 7) -> dict[str, tuple[float, float, float]]:
    """Spring positions of the few modules of a drawing, the same for the same input."""
    n = len(names)
    if not n:
        return {}
    at, place = np.random.default_rng(seed).normal(size=(n, 3)) * np.sqrt(n), {m: i for i, m in enumerate(names)}
    pull = np.zeros((n, n))
    for a, b, w in links:
        if a != b:
            pull[place[a], place[b]] = pull[place[b], place[a]] = np.log1p(w)
    for step in range(steps):
        away = at[:, None] - at[None]
        far = np.sqrt((away**2).sum(-1)) + 1e-6
        push = (away / far[..., None] ** 2).sum(1) - (away * (pull * far)[..., None] / 10).sum(1) - at * 0.01
        size = np.linalg.norm(push, axis=1, keepdims=True) + 1e-9
        at = at + push / size * np.minimum(size, 2.0 * (1 - step / steps))
    return {m: tuple(map(float, at[i])) for m, i in place.items()}


def module_key(kind: str = "kind", path: str = "path") -> Column:
    """The directory that a node belongs to, '.' for the root; null without a path."""
    above = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    return F.when(F.col(kind).isin("Module", "Dir"), F.col(path)).otherwise(F.when(F.col(path).isNotNull(), above))


def _even(salt: int) -> Column:
    """A number from 0 to 1 that only the id decides."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 24)) / float(1 << 24)


def _normal(salt: int) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(_even(salt), F.lit(1e-9)))) * F.cos(2 * math.pi * _even(salt + 1))


def _cloud(rows: DataFrame, around: str, size: tuple[float, float]) -> DataFrame:
    """x, y and z of rows in a filled ball around their centre (cx, cy, cz); one alone lies in the centre."""
    place = F.row_number().over(Window.partitionBy(around).orderBy("id")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(around))
    rows = rows.withColumn("_i", place).withColumn("_n", n).withColumn("_r", F.lit(size[0]) + size[1] * F.sqrt(F.col("_n").cast("double")))
    up = 1 - F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)) * 2
    flat, angle = F.sqrt(F.greatest(F.lit(0.0), 1 - up * up)), GOLDEN_ANGLE * F.col("_i")
    far = F.col("_r") * F.pow(_even(1), F.lit(0.7))
    ways = (F.cos(angle) * flat, up, F.sin(angle) * flat)
    for i, (axis, way) in enumerate(zip(AXES, ways, strict=True)):
        off = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(way * far + _normal(10 * (i + 1)) * F.col("_r") * 0.22)
        rows = rows.withColumn(axis, F.round(F.col(f"c{axis}") + off, 2))
    return rows.drop("_i", "_n", "_r", "cx", "cy", "cz")


def nebula(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, kind, path and more) with x, y and z.

    Modules are placed by springs between those that edges join; files lie in a cloud around
    their module, symbols around their file, libraries a quarter further out than the mean of
    their importers, or on a sphere without any. Only modules and their links meet on the driver.
    """
    known = nodes.withColumn("module", module_key())
    at = known.select("id", "module").filter("module is not null")
    ends = edges.select("src", "dst").join(at.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    links = ends.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b").collect()
    names = sorted(r["module"] for r in at.select("module").distinct().collect())
    spots = force(names, [(r["a"], r["b"], float(r["n"])) for r in links])
    reach = max((math.sqrt(sum(x * x for x in p)) for p in spots.values()), default=0) or 1.0
    centres = nodes.sparkSession.createDataFrame([(m, *(SPREAD * x / reach for x in p)) for m, p in spots.items()], "module string, cx double, cy double, cz double")
    placed = known.join(F.broadcast(centres), "module", "left")
    columns = [*nodes.columns, *AXES]
    centre = [F.round(f"c{axis}", 2).alias(axis) for axis in AXES]
    modules = placed.filter(F.col("kind").isin("Module", "Dir")).select(*nodes.columns, *centre)
    files = _cloud(placed.filter("kind = 'File'"), "module", FILE_CLOUD)
    inner = placed.filter(~F.col("kind").isin("Module", "Dir", "File", "Library")).withColumn("_file", F.coalesce("path", "id"))
    homes = files.select(F.col("path").alias("_file"), *[F.col(axis).alias(f"h{axis}") for axis in AXES]).dropDuplicates(["_file"])
    inner = inner.join(homes, "_file", "left").withColumns({f"c{axis}": F.coalesce(f"h{axis}", f"c{axis}", F.lit(0.0)) for axis in AXES}).drop(*(f"h{axis}" for axis in AXES))
    symbols = _cloud(inner, "_file", SYMBOL_CLOUD)
    done = modules.unionByName(files.select(*columns)).unionByName(symbols.select(*columns))
    from_ = edges.filter("kind = 'imports'").select("src", F.col("dst").alias("id")).join(done.select(F.col("id").alias("src"), *AXES), "src")
    mean = from_.groupBy("id").agg(*[F.avg(axis).alias(f"m{axis}") for axis in AXES])
    libraries = known.filter("kind = 'Library'").select(*nodes.columns).join(mean, "id", "left")
    up, angle = 2 * _even(50) - 1, 2 * math.pi * _even(51)
    lone = [190 * F.sqrt(1 - up * up) * F.cos(angle), 190 * up, 190 * F.sqrt(1 - up * up) * F.sin(angle)]
    outside = [F.round(F.coalesce(F.col(f"m{axis}") * 1.25 + 16 * _even(60 + i) - 8, lone[i]), 2).alias(axis) for i, axis in enumerate(AXES)]
    return done.unionByName(libraries.select(*nodes.columns, *outside))
