"""Sampled splitters: ranges of near-equal size over an ordered key, without a global sort.

A size-weighted sample of keys is drawn by hash (a row of size s enters with probability
min(1, s / step) and then stands for max(s, step)), its weighted quantiles are the
boundaries, and every record finds its range by binary search. Exact totals of each range
follow; ranges that came out overfull are sampled again, finer, and subdivided.
Only the sample and one total per range reach the driver, both bounded by parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES_PER_RANGE = 8
ROUNDS = 4


@dataclass
class Ranges:
    """Splitters in key order; totals holds (size, rows) of each range."""

    splitters: list[tuple]
    totals: list[tuple[int, int]]

    def before(self) -> list[tuple[int, int]]:
        """Size and rows of all ranges before each."""
        out, size, rows = [], 0, 0
        for s, n in self.totals:
            out.append((size, rows))
            size, rows = size + s, rows + n
        return out


def array_literal(values: list[int]) -> Column:
    """Longs as one constant array."""
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def range_of(keys: list[str], splitters: list[tuple]) -> Column:
    """How many splitters are at or below the key: its range, by binary search."""
    if not splitters:
        return F.lit(0)
    table = F.expr("array(" + ",".join("struct(" + ",".join(f"{v}L" for v in s) + ")" for s in splitters) + ")")
    key = F.struct(*[F.col(k).alias(f"col{i + 1}") for i, k in enumerate(keys)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    n = F.lit(len(splitters))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step <= n, F.when(F.element_at(table, at + step) <= key, at + step).otherwise(at)).otherwise(at))


def _sample(df: DataFrame, keys: list[str], size: str, step: float, seed: int) -> list[tuple]:
    chance = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return sorted(tuple(r) for r in df.filter(chance < F.col(size) / F.lit(step)).select(*keys, F.greatest(F.col(size).cast("double"), F.lit(step)).alias("_weight")).collect())


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    total, sum_, out = sum(r[-1] for r in sample), 0.0, []
    for row in sample:
        if out and row[:-1] == out[-1]:
            sum_ += row[-1]
            continue
        if sum_ >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(row[:-1])
        sum_ += row[-1]
    return out


def ranges(df: DataFrame, keys: list[str], size: str, parts: int, seed: int = 17) -> Ranges:
    """About `parts` ranges of near-equal total size. keys: long columns without nulls."""
    assert all(isinstance(df.schema[k].dataType, T.LongType) for k in keys)
    total, count = df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long"), F.count(F.lit(1))).first()
    if not count:
        return Ranges([], [(0, 0)])
    step = max(1.0, total / (parts * SAMPLES_PER_RANGE))
    splitters = _quantiles(_sample(df, keys, size, step, seed), parts)
    for turn in range(ROUNDS):
        found = {r["_range"]: (int(r["_size"]), int(r["_rows"])) for r in df.groupBy(range_of(keys, splitters).alias("_range")).agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_rows")).collect()}
        totals = [found.get(i, (0, 0)) for i in range(len(splitters) + 1)]
        over = [i for i, (s, n) in enumerate(totals) if s > 2.5 * total / parts and n > 1]
        if not over or turn == ROUNDS - 1:
            break
        inside = df.withColumn("_range", range_of(keys, splitters)).filter(F.col("_range").isin(over))
        more: dict[int, list[tuple]] = {}
        for row in _sample(inside, ["_range", *keys], size, max(1.0, step / 8 ** (turn + 1)), seed + turn + 1):
            more.setdefault(row[0], []).append(row[1:])
        new = {s for i, rows in more.items() for s in _quantiles(rows, 1 + max(1, round(totals[i][0] * parts / total)))} - set(splitters)
        if not new:
            break
        splitters = sorted({*splitters, *new})
    return Ranges(splitters, totals)
