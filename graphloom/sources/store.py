"""A stored graph: versions that appear whole, and edges that are looked up by either end.

A version is a folder of tables and a marker, written last; readers take the newest version
that has one, and stay with it. A write that fails leaves the version before in force. The
newest two versions stay, so a reader of the last but one can finish.

Edges are stored twice, once by their source and once by their target: dealt into buckets by a
hash of that end, a folder each, and sorted by it. A lookup of few ids opens their buckets only,
and within them the row groups whose range holds an id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a bucket, about.
BUCKET_EDGES = 1_000_000
DONE, VERSION = "_DONE", "v-"
KEPT = 2


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def versions(spark: SparkSession, where: str) -> list[tuple[int, bool]]:
    """Numbers of the versions in a folder, in order, and whether each is whole."""
    fs, top = _fs(spark, where)
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted((int(n[len(VERSION) :]), exists(spark, f"{where}/{n}/{DONE}")) for n in names if n.startswith(VERSION) and n[len(VERSION) :].isdigit())


def current(spark: SparkSession, where: str) -> str | None:
    """The folder of the newest whole version."""
    whole = [n for n, done in versions(spark, where) if done]
    return f"{where}/{VERSION}{whole[-1]}" if whole else None


def publish(spark: SparkSession, where: str, fill: Callable[[str], None]) -> str:
    """A new version that fill(folder) writes; it counts from the moment that its marker is there."""
    known = versions(spark, where)
    folder = f"{where}/{VERSION}{known[-1][0] + 1 if known else 1}"
    fill(folder)
    fs, marker = _fs(spark, f"{folder}/{DONE}")
    fs.create(marker, False).close()
    whole = [n for n, done in known if done][1 - KEPT :] if KEPT > 1 else []
    for n, _ in known:
        if n not in whole:
            fs, old = _fs(spark, f"{where}/{VERSION}{n}")
            fs.delete(old, True)
    return folder


def bucket(end: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(buckets)).cast("int")


def write_by_end(edges: DataFrame, path: str, end: str, buckets: int) -> None:
    dealt = edges.withColumn("bucket", bucket(end, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", end, "kind")
    dealt.write.partitionBy("bucket").parquet(path)


@dataclass
class Lookup:
    """Edges by source and by target."""

    out: DataFrame
    into: DataFrame
    buckets: int

    @classmethod
    def write(cls, edges: DataFrame, folder: str) -> None:
        buckets = max(1, edges.count() // BUCKET_EDGES)
        write_by_end(edges, f"{folder}/edges_out", "src", buckets)
        write_by_end(edges, f"{folder}/edges_in", "dst", buckets)
        edges.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/buckets")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Lookup:
        buckets = spark.read.parquet(f"{folder}/buckets").first()[0]
        return cls(*(spark.read.parquet(f"{folder}/edges_{side}") for side in ("out", "in")), buckets)

    def near(self, end: str, ids: list) -> DataFrame:
        """The edges whose end, src or dst, is one of the ids."""
        spark, table = self.out.sparkSession, self.out if end == "src" else self.into
        kind = table.schema[end].dataType
        # the hash is Spark's own, of a local table that it folds while planning
        wanted = sorted({r[0] for r in spark.createDataFrame([(i,) for i in ids], f"{end} {kind.simpleString()}").select(bucket(end, self.buckets)).collect()}) if self.buckets > 1 else [0]
        return table.filter(F.col("bucket").isin(wanted) & F.col(end).isin(ids)).drop("bucket")
