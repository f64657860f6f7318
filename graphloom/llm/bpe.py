"""Byte-level BPE encoding and decoding, with long texts cut into overlapping chunks.

Texts of at most `chunk_chars` are encoded where they lie. A longer one is cut into
overlapping chunks that are dealt over the cluster and pre-tokenised there in parallel.
A chunk starts anywhere, so its first pre-tokens may be wrong; the pattern keeps no state
between matches, so from the first start that two neighbours share on they agree for good.
The starts are stitched there, the text is cut into pieces at true starts, and the pieces,
dealt out again, are encoded. Decoding concatenates the bytes of the ids.

Null and empty texts have no ids. Rows are kept as they are: repeated rows and null ids
give a row each, and extra columns, whatever their names, play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows, small

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
IDS = "doc_id {id}, n_tokens long, ids binary, decoded binary"


@lru_cache(maxsize=4)
def _codec(vocabulary: bytes, pattern: str):
    """tiktoken's encoder and the bytes of each id."""
    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, vocabulary.splitlines())}
    table = {rank: word for word, rank in ranks.items()}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(text: str, vocabulary: bytes, pattern: str) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return np.array(_codec(vocabulary, pattern)[0].encode_ordinary(text), dtype="<u4")


def decode(ids: np.ndarray, vocabulary: bytes, pattern: str) -> bytes:
    """The raw bytes behind ids."""
    return b"".join(map(_codec(vocabulary, pattern)[1].__getitem__, ids.tolist()))


def starts(chunk: str, pattern: str) -> np.ndarray:
    """Where the pre-tokens of a chunk start."""
    return np.fromiter((m.start() for m in _pattern(pattern).finditer(chunk)), dtype=np.int64)


def stitch(text: str, found: list[np.ndarray], step: int, pattern: str) -> Iterator[int]:
    """True starts of the pre-tokens of a text, from the starts found in its chunks.

    found[k] has absolute starts from k * step on. The last two of a chunk that does not
    end the text are left out: what follows the chunk could change them. Where no chunk
    knows the current start (a pre-token longer than the overlap), one match is made.
    """
    known = [a if k == len(found) - 1 else a[:-2] for k, a in enumerate(found)]
    at, match = 0, _pattern(pattern).match
    while at < len(text):
        for k in (min(at // step, len(known) - 1), min(at // step, len(known) - 1) - 1):
            i = int(np.searchsorted(known[k], at)) if k >= 0 else 0
            if k >= 0 and i < len(known[k]) and known[k][i] == at and (len(known[k]) - i > 1 or k == len(known) - 1):
                yield from known[k][i:].tolist() if k == len(known) - 1 else known[k][i:-1].tolist()
                at = len(text) if k == len(known) - 1 else int(known[k][-1])
                break
        else:
            yield at
            at = m.end() if (m := match(text, at)) and m.end() > at else at + 1


def pieces(text: str, true_starts: Iterator[int], size: int) -> Iterator[str]:
    """The text, cut at true starts into pieces of about the given size."""
    begin = 0
    for at in true_starts:
        if at - begin >= size:
            yield text[begin:at]
            begin = at
    yield text[begin:]


def _whole(vocabulary, pattern: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = [encode(t or "", vocabulary.value, pattern) for t in batch.column("text").to_pylist()]
            raw = [decode(ids, vocabulary.value, pattern) for ids in out]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, out), pa.int64()), pa.array([x.tobytes() for x in out], pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return run


def _chunks(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for doc_id, text in rows(batches, "doc_id", "text"):
            for k, at in enumerate(range(0, len(text), chunk)):
                yield pa.RecordBatch.from_pydict({"rid": [part << 33 | n], "doc_id": [doc_id], "k": [k], "text": [text[at : at + chunk + overlap]]})
            n += 1

    return run


def _starts(chunk: int, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(starts(t, pattern) + k * chunk).tobytes() for k, t in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("rid", "doc_id", "k", "text")), pa.array(found, pa.binary())], names=["rid", "doc_id", "k", "text", "starts"])

    return run


def _pieces(chunk: int, pattern: str) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        parts = group.column("text").to_pylist()
        text = "".join(p[:chunk] for p in parts)
        found = [np.frombuffer(b, dtype=np.int64) for b in group.column("starts").to_pylist()]
        cut = list(pieces(text, stitch(text, found, chunk, pattern), chunk))
        return pa.table({"rid": [group.column("rid")[0].as_py()] * len(cut), "doc_id": pa.array([group.column("doc_id")[0].as_py()] * len(cut), group.column("doc_id").type), "k": list(range(len(cut))), "text": cut})

    return run


def _joined(group: pa.Table) -> pa.Table:
    group = group.sort_by("k")
    ids = b"".join(group.column("ids").to_pylist())
    return pa.table({"doc_id": group.column("doc_id").slice(0, 1), "n_tokens": [len(ids) // 4], "ids": pa.array([ids], pa.binary()), "decoded": pa.array([b"".join(group.column("decoded").to_pylist())], pa.binary())})


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded of every text.

    docs: has doc_id and text. The vocabulary is a file of ranks on the driver, under a
    megabyte, which travels as a broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = IDS.format(id=kind)
    plain = spark.createDataFrame([], out).toArrow().schema
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = docs.filter(~long).mapInArrow(_whole(vocabulary, pattern, plain), out)

    def whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t, vocabulary.value, pattern) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), batch.column("k"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, vocabulary.value, pattern) for x in ids], pa.binary())], names=["rid", "doc_id", "k", "ids", "decoded"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = f"rid long, doc_id {kind}, k long, text string"
    found = (
        docs.filter(long)
        .mapInArrow(_chunks(chunk_chars, overlap_chars), cut)
        .repartition(n, "rid", "k")
        .mapInArrow(_starts(chunk_chars, pattern), f"{cut}, starts binary")
        .groupBy("rid")
        .applyInArrow(_pieces(chunk_chars, pattern), cut)
        .repartition(n, "rid", "k")
        .mapInArrow(whole_pieces, f"rid long, doc_id {kind}, k long, ids binary, decoded binary")
        .groupBy("rid")
        .applyInArrow(_joined, out)
    )
    return short.unionByName(found)


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of the query: lengths and SHA-256 digests of ids and decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference_digests(text: str | None, vocabulary: bytes, pattern: str) -> tuple[int, str, str]:
    """What tiktoken alone gives for a text; tests compare with it."""
    ids = _codec(vocabulary, pattern)[0].encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
