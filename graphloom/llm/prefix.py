"""Running sums within large groups, in two levels so that no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, group: str, bucket: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows of the same group that come before.

    Rows of a group are ordered by bucket and then by order. Only one total per (group,
    bucket) is summed along a group; rows are summed within their bucket.
    """
    df = df.withColumn("_value", value)
    totals = df.groupBy(group, bucket).agg(F.sum("_value").alias("_total"))
    along = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.withColumn("_before", F.sum("_total").over(along) - F.col("_total")).drop("_total")
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_inside", F.sum("_value").over(inside) - F.col("_value")).join(offsets, [group, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_value", "_inside", "_before")
