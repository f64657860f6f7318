"""What the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract; Python's bytes.split() cuts at exactly the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of texts that Python works on at once.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(batches: Iterator, rows_: int = BATCH_ROWS) -> Iterator:
    """Arrow batches in slices of few rows, so that what is made of one slice stays small.

    Spark bounds a batch by its bytes already; a slice shares the memory of its batch.
    """
    for batch in batches:
        for begin in range(0, max(1, batch.num_rows), rows_):
            yield batch.slice(begin, rows_)


def id_crc(doc_id: object) -> int:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def id_crc_column(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def table_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column, for sizing partitions."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])
