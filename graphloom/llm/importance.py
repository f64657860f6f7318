"""Importance resampling towards a target: word tries count features, then carry their gains.

A feature is a run of 1 to `longest` consecutive words, joined by one space; its bucket is the
crc32 of its bytes modulo the number of buckets. Each task grows a trie of the words it meets:
a node is a run of words and holds how often the run came and the crc state of its bytes, so a
child's crc costs its own word alone. A trie that has grown to `MOST_NODES` nodes is added to
the task's bucket totals and begun anew. Spark adds the totals of all tasks, which number at
most one row a bucket and task, whatever the texts.

Gains of the buckets (a bounded table) go out with the second pass, in which each task walks
its documents along a trie again, its nodes now with the gain of their bucket attached. Scores
are whole numbers in a bounded range, so one count a score tells how many documents lie above
each, and only documents at or above the last score drawn are ordered, score by score.

Null and empty texts, and those without words, have no features and weight 0; they count as
documents without words. A null id counts as empty text in the draw and comes last among ties. Repeated
rows each count and each have a rank; ties fall to the smaller id, then to fewer features.
Extra columns, whatever their names, play no part. An empty table gives no rows; an empty
target leaves gains that only the documents' own counts make.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import durable
from graphloom.llm.common import small

LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Nodes after which a trie is emptied, and words that are walked between two looks at its size.
MOST_NODES, STRETCH = 200_000, 50_000
#: What is no word: every ASCII byte but digits and letters. Upper-case letters become lower-case.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Node:
    """A run of words: how often it came, the crc state of its bytes, its gain, and the runs that go on from it."""

    __slots__ = ("count", "crc", "gain", "after")

    def __init__(self, crc: int, gain: int) -> None:
        self.count, self.crc, self.gain, self.after = 0, crc, gain, {}


class Trie:
    """The runs of words that a task has met, with the gains of their buckets if there are any."""

    def __init__(self, longest: int, gains: list[int] | None = None) -> None:
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = Node(0, 0), 0

    def _grow(self, node: Node, word: bytes) -> Node:
        crc = zlib.crc32(word if node is self.root else b" " + word, node.crc)
        child = node.after[word] = Node(crc, self.gains[crc % len(self.gains)] if self.gains else 0)
        self.nodes += 1
        return child

    def walk(self, run: list[bytes], begin: int, end: int) -> int:
        """The sum of the gains of all features that begin at words begin to end - 1; each is counted."""
        total, longest, root = 0, self.longest, self.root
        for i in range(begin, end):
            node = root
            for word in run[i : i + longest]:
                node = node.after.get(word) or self._grow(node, word)
                node.count += 1
                total += node.gain
        return total

    def add_to(self, totals: np.ndarray) -> None:
        """The counts of all nodes, added to the totals of their buckets."""
        rest = [self.root]
        while rest:
            for child in rest.pop().after.values():
                totals[child.crc % len(totals)] += child.count
                rest.append(child)


def n_features(n_words: int, longest: int) -> int:
    return sum(max(0, n_words - k) for k in range(longest))


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(longest), np.zeros(buckets, np.int64)
        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                own = words(text)
                for begin in range(0, len(own), STRETCH):
                    trie.walk(own, begin, min(len(own), begin + STRETCH))
                    if trie.nodes >= MOST_NODES:
                        trie.add_to(totals)
                        trie.clear()
        trie.add_to(totals)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(totals[used], pa.int64())})

    return run


def bucket_totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts (column text) fall in each bucket that has any."""
    return texts.select("text").mapInArrow(_counted(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the totals of the documents and of the target."""
    every, wanted = sum(own.values()), sum(target.values())
    gain = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(every + buckets) / (float(s + 1) * float(wanted + buckets))))
    return [gain(own.get(b, 0), target.get(b, 0)) for b in range(buckets)]


def _weighed(longest: int, gained: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, gained)
        for batch in small(batches):
            n_words, weights = [], []
            for text in batch.column("text").to_pylist():
                own, total = words(text), 0
                for begin in range(0, len(own), STRETCH):
                    total += trie.walk(own, begin, min(len(own), begin + STRETCH))
                    if trie.nodes >= MOST_NODES:
                        trie.clear()
                n_words.append(len(own))
                weights.append(total // n_features(len(own), longest) if own else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([n_features(n, longest) for n in n_words], pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def luck(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A Gumbel deviate in thousandths that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (written; doc_id, n_words, n_features, score) with rank, null for those not drawn."""
    able = F.col("n_words") >= least_words
    steps = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = durable(steps.withColumn("_before", F.sum("_n").over(down) - F.col("_n")), "resample-steps")
    drawn = percent * (steps.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // 100
    reached = steps.filter(F.col("_before") < drawn)
    last = reached.agg(F.min("score")).first()[0]
    high = able & (F.col("score") >= F.lit(last).cast("long")) if last is not None else F.lit(False)
    ties = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    place = F.col("_before") + F.row_number().over(ties)
    top = scored.filter(high).join(F.broadcast(reached.select("score", "_before")), "score").withColumn("rank", place.cast("long"))
    top = top.select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return top.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; target: the texts to resemble."""
    totals = [{r.bucket: r.n for r in bucket_totals(texts, longest, buckets).collect()} for texts in (docs, target)]
    weighed = docs.select("doc_id", "text").mapInArrow(_weighed(longest, gains(*totals, buckets)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    scored = durable(weighed.withColumn("score", F.col("weight") + luck(seed=seed)), "resample-scores")
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
