"""Written tables in the shared folder of the cluster, to cut lineage durably.

A table written here outlives the executor that wrote it, unlike a cached or locally
checkpointed one. The folder is the one the session names in spark.checkpoint.dir; only
a local master without that setting falls back to a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/graphloom"


#: What one Arrow batch on its way to Python holds at most while a table is written.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; its own stands again after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Arrow batches of few bytes for the jobs that run inside; the session's own bound stands again after."""
    return setting(spark, _BATCH, BATCH_BYTES)


def packed(spark: SparkSession):
    """Tables of texts, names and ids are written in less room inside; the session's own codec stands again after."""
    return setting(spark, "spark.sql.parquet.compression.codec", "zstd")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.path = path
    if (made := _SCRATCH.get()) is not None:
        made.append(stored)
    return stored


def swept(stored: DataFrame) -> DataFrame:
    """A table that durable() has written, once sweep() has run."""
    sweep(stored.sparkSession)
    return stored


def together(parts: list[DataFrame]) -> DataFrame:
    """The tables of durable() in a list, of one schema, as one."""
    paths = tuple(p.path for p in parts)
    found = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)
    found.path = paths
    return found


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that durable() writes inside are listed, and deleted at the end unless taken off the list."""
    made: list[DataFrame] = []
    before = _SCRATCH.set(made)
    try:
        yield made
    finally:
        _SCRATCH.reset(before)
    discard(*made)


def written(df: DataFrame) -> bool:
    """Whether a table of durable() is still there."""
    return set(_paths(df)) <= set(_WRITTEN.get(df.sparkSession.sparkContext.applicationId, []))


def _paths(df: DataFrame) -> tuple[str, ...]:
    return (df.path,) if isinstance(df.path, str) else df.path


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def discard(*stored: DataFrame) -> None:
    """Delete tables that durable() wrote and that nothing reads any more: all that was made of them is written."""
    for df in stored:
        written = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
        for path in _paths(df):
            if path in written:
                written.remove(path)
                _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more.

    It does so when the driver collects its garbage, which a large heap puts off; what was made
    of those plans is written by then. Spark's listeners hold the plan of the last query until
    the next one ends, so a query without a shuffle comes before.
    """
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Delete what durable() wrote in this application; call it when its results are stored."""
    return sum(_delete(spark, path) for path in _WRITTEN.pop(spark.sparkContext.applicationId, []))
