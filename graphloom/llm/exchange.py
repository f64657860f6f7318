"""Totals by key for blocks of keys, looked up in bulk.

A block is one row with an array of unsigned 64-bit keys, unique within the block, and a
weight for each. Keys are dealt to parts by hash; a part sums the weights of a key over all
blocks and answers every block with the totals of the keys it sent, in the order sent. So
a table of any size is looked up with a few large rows, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a part holds at once, about: keys of one part are this many bytes of input.
PART_BYTES = 8 << 20
STATS = -1


def parts_for(spark, size: int) -> int:
    """How many parts a table of keys with this many bytes needs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; the low bits stay free for what a caller packs there."""
    return (keys >> np.uint64(8)) % np.uint64(parts)


def totals(blocks: DataFrame, parts: int, stats: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """block, part and totals (int64, in the order of the block's keys of that part).

    blocks: block long, keys binary, weights binary (int64; empty: 1 each). With stats,
    each part also gives a row of block -1 whose totals are stats(keys, totals).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, weights in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "weights")), strict=True):
                k = np.frombuffer(keys, "<u8")
                w = np.frombuffer(weights, "<i8") if weights else np.ones(len(k), "<i8")
                p = part_of(k, parts)
                order = np.argsort(p, kind="stable")
                edges = np.searchsorted(p[order], np.arange(parts + 1))
                k, w = k[order], w[order]
                own = [i for i in range(parts) if edges[i] < edges[i + 1]]
                yield pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int64()), "block": pa.array([block] * len(own), pa.int64()), "keys": pa.array([k[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary()), "weights": pa.array([w[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary())})

    def meet(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in group.column("keys").to_pylist()]
        weights = np.concatenate([np.frombuffer(w, "<i8") for w in group.column("weights").to_pylist()])
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(unique), "<i8")
        np.add.at(total, where, weights)
        answers, at = [], 0
        for k in keys:
            answers.append(total[where[at : at + len(k)]].astype("<i8").tobytes())
            at += len(k)
        block, part = group.column("block").to_pylist(), group.column("part").to_pylist()
        if stats:
            block, part, answers = [*block, STATS], [*part, part[0]], [*answers, stats(unique, total)]
        return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array(part, pa.int64()), "totals": pa.array(answers, pa.binary())})

    dealt = blocks.select("block", "keys", "weights").mapInArrow(deal, "part long, block long, keys binary, weights binary")
    return dealt.groupBy("part").applyInArrow(meet, "block long, part long, totals binary")


def answered(keys: np.ndarray, parts: int, answers: pa.Table) -> np.ndarray:
    """The totals of a block's keys, put together from the answers of all parts."""
    out, p = np.zeros(len(keys), "<i8"), part_of(keys, parts)
    order = np.argsort(p, kind="stable")
    edges = np.searchsorted(p[order], np.arange(parts + 1))
    for part, blob in zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True):
        out[order[edges[part] : edges[part + 1]]] = np.frombuffer(blob, "<i8")
    return out
