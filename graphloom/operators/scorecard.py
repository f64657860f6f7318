"""Readiness factors: trapezoid and linear scores of per-file, per-symbol and graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the five metrics and least mean of each grade.
WEIGHTS = {"navigability": 0.22, "context_efficiency": 0.22, "modularity": 0.20, "complexity": 0.18, "self_description": 0.18}
GRADES = ((92, "A+"), (85, "A"), (78, "B+"), (70, "B"), (62, "C+"), (54, "C"), (45, "D"), (0, "F"))


def lower_better(x: Column, good: float, bad: float) -> Column:
    """100 up to good, 0 from bad, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(float(bad)) - x) / (bad - good) * 100))


def higher_better(x: Column, bad: float, good: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - F.lit(float(bad))) / (good - bad) * 100))


def band(x: Column, low: float, high: float, least: float, most: float) -> Column:
    """100 between low and high, falling to 0 at least and at most."""
    below = F.lit(100.0) if low == least else (x - least) / (low - least) * 100
    above = (F.lit(float(most)) - x) / (most - high) * 100
    return F.when((x >= low) & (x <= high), 100.0).otherwise(F.greatest(F.lit(0.0), F.when(x < low, below).otherwise(above)))


def p95(values: DataFrame, column: str, bins: int = 4096, few: int = 100_000) -> DataFrame:
    """One row: the value at place int(0.95 n) of the sorted values (from 1), the largest for five or fewer.

    Counts per bin of the value range narrow the place down until the bin that holds it has
    few distinct values; only that bin is sorted. At most `bins` counts reach the driver.
    """
    known = values.filter(F.col(column).isNotNull()).select(F.col(column))
    n, low, high = known.agg(F.count(F.lit(1)), F.min(column).cast("double"), F.max(column).cast("double")).first()
    place, inside = (int(n * 0.95) if n > 5 else n), known
    while n and high > low and inside.select(F.approx_count_distinct(column)).first()[0] > few:
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column).cast("double") - low) / (high - low) * bins))
        counts = sorted(inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).collect(), key=lambda r: r["b"])
        for r in counts:
            if place <= r["n"]:
                break
            place -= r["n"]
        inside, low, high = inside.filter(F.col(column).cast("double").between(r["low"], r["high"])), r["low"], r["high"]
    per = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= place).agg(F.min(column).alias("p95"))


def duplication(files: DataFrame) -> DataFrame:
    """One row: the share of files beyond the first of equal (code_lines, branches, n_symbols)."""
    per = files.groupBy("code_lines", "branches", "n_symbols").agg(F.count(F.lit(1)).alias("c"))
    return per.agg((F.sum(F.col("c") - 1) / F.sum("c")).alias("duplication"))


def cryptic(name: Column) -> Column:
    """Whether a name tells nothing: very short, or a short run of capitals."""
    return ((F.length(name) <= 2) & ~name.isin("id", "ok", "db", "io")) | ((F.length(name) <= 3) & (F.upper(name) == name) & (F.lower(name) != name))


def coupling(edges: DataFrame, files: DataFrame) -> DataFrame:
    """fan_out (mean distinct imports over all files) and risky (files with more than 12 importers)."""
    used = edges.filter("kind = 'imports'").select("src", "dst").distinct()
    out = used.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    risky = used.groupBy("dst").agg(F.count(F.lit(1)).alias("i")).filter("i > 12").agg(F.count(F.lit(1)).alias("risky"))
    return files.select("id").join(out, "id", "left").agg(F.avg(F.coalesce("o", F.lit(0))).alias("fan_out"), F.count(F.lit(1)).alias("files")).join(F.broadcast(risky))


def weighted(factors: dict[str, tuple[float, float]]) -> float:
    """Weighted mean of (score, weight), rounded once on the driver as Python rounds."""
    return round(sum(s * w for s, w in factors.values()) / sum(w for _, w in factors.values()), 1)


def grade(mean: float) -> str:
    return next(g for least, g in GRADES if mean >= least)
