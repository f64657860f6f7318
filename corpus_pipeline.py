"""A training corpus from raw documents: rules, near-duplicates, secrets, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, and extra
columns as they came, whatever their names. Every stage works on whole texts of any length and
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.durable import discard, durable, scratch
from graphloom.llm import bpe, mixing, near_dedup, quality_rules, secret_scan


#: Shared five-word shingles of 100 that make two documents near-duplicates.
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go; null languages and sources are groups of
    their own; repeated rows share a verdict and stay as often as they came.
    """
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least id.

    Ids without a value come last. Of rows with equal id and text one stays. Texts without
    words are no one's duplicates and stay.
    """
    return near_dedup.keep_documents(docs, SIMILAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; its length follows.

    Overlapping secrets become one mark. Null and empty texts and repeated rows stay as they
    are; the length of a null text is not touched.
    """
    return secret_scan.mask_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for it, in the order of the schedule.

    A null source is a source of its own. Texts without words stay once. Rows equal in id,
    text and source are taken equally often; ties in the order fall by their hashes.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as base 64 of little-endian unsigned 32-bit integers, with digests.

    Null and empty texts have no ids and still a row; repeated rows have a row each.
    """
    import public_tokenizers

    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.base64("ids").alias("ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: Robust estimates, sketches and the schedule have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as made:
            docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
