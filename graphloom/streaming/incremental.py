"""Streams: a table of documents kept current by content hash, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_current(stream: DataFrame, out: str, checkpoint: str, key: str = "path", content: str = "content", order: str | None = None) -> StreamingQuery:
    """The rows of each batch that are new or changed, by content hash, stored under out as versions.

    order: a column that grows from version to version of a row, and says which of a batch's
    rows of one key is the latest; without it a key must come at most once a batch, or the
    batch fails. Rows whose content is what is stored already are left out. A batch is written
    under its own number, so a batch that is tried again writes the same files once more.
    """

    def store(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("hash", F.sha1(content))
        if order is None:
            twice = hashed.groupBy(key).agg(F.countDistinct("hash").alias("n")).filter("n > 1").limit(1).collect()
            if twice:
                raise ValueError(f"{key} {twice[0][0]!r} came with two contents in one batch; name the column that orders them")
        rank = F.col(order) if order else F.lit(0)
        newest = hashed.groupBy(key).agg(F.max_by(F.struct(*[c for c in hashed.columns if c != key]), rank).alias("v")).select(key, "v.*")
        before = current(batch.sparkSession, out, key, below=number)
        if before is not None:
            newest = newest.join(before.select(key, "hash"), [key, "hash"], "left_anti")
        newest.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the stored batches; a compacted one stands for all before it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def current(spark: SparkSession, out: str, key: str = "path", below: int | None = None) -> DataFrame | None:
    """The newest version of each row that keep_current() has stored, of batches below a number if one is given."""
    used = [n for n in _batches(spark, out) if below is None or n < below]
    if not used:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{out}/batch={n}" for n in used])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("v")).select(key, "v.*")


def compact(spark: SparkSession, out: str, key: str = "path") -> int:
    """Replace all stored batches by their newest rows; returns how many batches went. Call it while no stream runs."""
    used = _batches(spark, out)
    if len(used) < 2:
        return 0
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    current(spark, out, key).write.mode("overwrite").parquet(f"{out}/_compacted")
    # rows keep their versions, so readers see the same state whichever batches are already gone
    system.delete(path(f"batch={used[-1]}"), True)
    system.rename(path("_compacted"), path(f"batch={used[-1]}"))
    return sum(bool(system.delete(path(f"batch={n}"), True)) for n in used[:-1])


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event type; rows later than the watermark are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
