"""Joins with a table of unique keys where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this many rows, and more than this share of them; so few are.
HOT_ROWS, MOST_HOT = 128, 10_000
#: Tasks that share the rows of a hot key.
FAN = 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys of many rows, at most MOST_HOT of them, from a table of keys and their numbers of rows."""
    return counts.filter(F.col(n) > max(HOT_ROWS, total // MOST_HOT)).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left with the row that right has for its key; how: inner or left.

    right: unique keys. hot: what hot_keys() finds, so it is broadcast. Rows of a hot key are
    dealt by the column `by` over FAN copies of the row of right.
    """
    hot = F.broadcast(hot.select(F.col(key).alias("_hot")))
    deal = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(FAN)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(FAN - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, left[key] == F.col("_hot"), "left").withColumn("_deal", deal).drop("_hot")
    copied = right.join(hot, right[key] == F.col("_hot"), "left").withColumn("_deal", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [key, "_deal"], how).drop("_deal")
