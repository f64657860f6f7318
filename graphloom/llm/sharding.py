"""Sharding by sampled splitters: contiguous key ranges, shards of near-equal bytes.

Records are ordered by (hash of the text, id, tag): equal texts lie side by side, and the
tag, stored once, tells repeated rows apart, so that no range is too full to subdivide.
Many more ranges than shards are cut; the exact bytes before each range plus a running sum
inside it give every record its place in the order, and the shard follows from the place.
A group of equal texts counts as one record where it is no larger than the largest record or
than `WHOLE` of a shard, so it stays in one shard; larger groups are cut like other records.
A shard then misses an equal share by less than one such unit.

Null texts have no bytes, null ids sort as the smallest, repeated rows get a slot each,
extra columns play no part, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import durable
from graphloom.llm.spread import hot_keys, spread_join
from graphloom.llm.splitters import array_literal, range_of, ranges

ROW_BYTES = 16
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 2_000_000
MOST_RANGES = 4_096
#: The share of a shard up to which a group of equal records is kept whole.
WHOLE = 0.01


def assign(records: DataFrame, keys: list[str], size: str, shards: int, group: str | None = None) -> DataFrame:
    """records with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    keys: long columns without nulls that order the records; size: a long column; group: the
    first of the keys, if records that share it belong together. The records travel whole, so
    pass only the columns wanted.
    """
    assert group is None or group == keys[0]
    stored = durable(records.withColumn("_tag", F.monotonically_increasing_id()), "shard-records")
    keys = [*keys, "_tag"]
    parts = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, stored.count() // ROWS_PER_RANGE))
    cut = ranges(stored, keys, size, parts)
    total = max(1, sum(s for s, _ in cut.totals))
    inside = Window.partitionBy("_range").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("_range") + 1
    bytes_before, rows_before = (array_literal([b[i] for b in cut.before()]) for i in (0, 1))
    placed = stored.withColumn("_range", range_of(keys, cut.splitters)).select(
        *records.columns,
        (F.element_at(bytes_before, at) + F.sum(size).over(upto) - F.col(size)).alias("_bytes"),
        (F.element_at(rows_before, at) + F.row_number().over(inside) - 1).alias("_row"),
    )
    middle = F.col("_bytes") + (F.col(size) / 2).cast("long")
    if group is not None:
        placed = durable(placed, "shard-order")
        most = max(placed.agg(F.coalesce(F.max(size), F.lit(0))).first()[0], int(WHOLE * total / shards))
        groups = durable(placed.groupBy(group).agg(F.min("_bytes").alias("_begin"), F.sum(size).alias("_whole"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1), "shard-groups")
        whole = groups.filter(F.col("_whole") <= most).drop("_n")
        placed = spread_join(placed, whole, group, "_row", hot_keys(groups, group, "_n", placed.count()), "left")
        middle = F.coalesce(F.col("_begin") + (F.col("_whole") / 2).cast("long"), middle)
    placed = durable(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / total)).cast("int")).drop("_bytes", "_begin", "_whole"), "shard-places")
    first = {r["shard"]: int(r["_first"]) for r in placed.groupBy("shard").agg(F.min("_row").alias("_first")).collect()}
    starts = array_literal([first.get(i, 0) for i in range(shards)])
    return placed.withColumn("slot", F.col("_row") - F.element_at(starts, F.col("shard") + 1)).drop("_row")


def keyed(docs: DataFrame) -> DataFrame:
    """What orders and sizes documents: doc_id, size, text_crc32 and the keys."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"),
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    return assign(keyed(docs), ["_text", "_id"], "size", shards, group="_text").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
