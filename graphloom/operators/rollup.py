"""Directory roll-ups over all ancestors, and the collapse of pass-through directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASS_SHARE = 0.9


def ancestors(path: str = "path"):
    """The directories above a path, the root as '.'."""
    parts = F.split(F.col(path), "/")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, below).otherwise(F.array().cast("array<string>")))


def directories(files: DataFrame) -> DataFrame:
    """dir, files and loc, summed over every file below."""
    return files.select(F.explode(ancestors()).alias("dir"), "loc").groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


def parent(column: str = "dir"):
    return F.when(F.col(column) == ".", F.lit(None)).when(F.instr(column, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(column, "/[^/]*$", ""))


def collapsed(rolled: DataFrame, share: float = PASS_SHARE) -> DataFrame:
    """Directories but for those that pass nearly all their files on to one child; the root stays."""
    child = rolled.select(parent().alias("dir"), F.col("files").alias("child")).groupBy("dir").agg(F.max("child").alias("most"))
    passing = rolled.join(child, "dir").filter((F.col("dir") != ".") & (F.col("most") >= share * F.col("files"))).select("dir")
    return rolled.join(passing, "dir", "left_anti")
