"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes hashed term counts: words, word shapes and a few shares (repeated words and
lines, length). A truncated singular value decomposition of a bounded labelled sample gives
the latent space. The labelled vectors, a matrix of `SAMPLE` by `LATENT`, are broadcast;
each batch of documents is multiplied with all of them, blocked, so the cosines are exact;
the labels of the `NEIGHBOURS` nearest are weighted by similarity.

The sample is bounded by the parameter `sample`; every document is scored on its whole text.
Null and empty texts are texts without terms and get the label share of the sample. Repeated
rows are scored each. Without labels every score is the given prior. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small
from graphloom.llm.text_features import Terms, bare, held_out, labelled_sample, shapes

SAMPLE = 4_096
LATENT = 64
NEIGHBOURS = 25
SHARPNESS = 4.0
THRESHOLD = 0.7
PRIOR = 0.5
WORD_DIMS, SHAPE_DIMS, SHARE_DIMS = 2_048, 512, 16
DIMS = WORD_DIMS + SHAPE_DIMS + SHARE_DIMS
#: Weights of the three parts of a vector, each of unit length before.
WEIGHTS = (0.5, 1.0, 1.0)


def vector(text: str | None, terms: Terms) -> np.ndarray:
    """The term vector of a text; zero for a text without words."""
    out = np.zeros(DIMS, np.float32)
    packed = terms.of(text)
    n = len(packed)
    if not n:
        return out
    word, form = bare(packed), shapes(packed)
    out[:WORD_DIMS] = np.log1p(np.bincount(word % WORD_DIMS, minlength=WORD_DIMS))
    out[WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = np.sqrt(np.bincount(form % SHAPE_DIMS, minlength=SHAPE_DIMS) / n)
    lines = [line for line in text.split("\n") if line.strip()]
    size = min(7, int(np.log10(n) * 2))
    share = out[WORD_DIMS + SHAPE_DIMS :]
    share[0] = 2 * np.sqrt(np.count_nonzero(word[1:] == word[:-1]) / n)
    share[1] = 1 - len(set(lines)) / max(1, len(lines))
    share[2] = 1 - len(np.unique(word)) / n
    share[3 + size] = 0.5
    share[12] = 0.5
    for part, weight in zip((out[:WORD_DIMS], out[WORD_DIMS : WORD_DIMS + SHAPE_DIMS], share), WEIGHTS, strict=True):
        part *= weight / max(1e-9, float(np.linalg.norm(part)))
    return out


def basis(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """The leading k right singular vectors, by randomised subspace iteration."""
    k = min(k, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(seed).normal(size=(x.shape[1], min(x.shape[1], k + 16))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Voters:
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Voters:
    """Latent space and labelled vectors, from at most `sample` labelled documents."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in small(batches):
            found = [vector(t, terms).astype("<f2").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "vector"])

    chosen = labelled_sample(docs, labels, [column], sample).select("doc_id", F.col(f"label_{column}").alias("label"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(vectors, f"doc_id {kind}, label double, vector binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("vector").alias("vector")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["vector"], "<f2") for r in rows], np.float32).reshape(-1, DIMS)
    y = np.array([r["label"] for r in rows], np.float32)
    if not len(x):
        return Voters(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), y, PRIOR)
    space = basis(x, LATENT)
    return Voters(space, unit(x @ space), y, float(y.mean()))


def vote(x: np.ndarray, voters: Voters, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The similarity-weighted label of each row of term vectors."""
    if not len(voters.labels):
        return np.full(len(x), voters.prior)
    cosine = unit(x @ voters.space) @ voters.vectors.T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(float), 0) ** SHARPNESS
    total = weight.sum(1)
    score = (weight * voters.labels[near]).sum(1) / np.maximum(total, 1e-12)
    return np.clip(np.where(total > 1e-9, score, voters.prior), 0, 1)


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    voters = spark.sparkContext.broadcast(fit(docs, labels, column, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in small(batches):
            ids = batch.column("doc_id")
            x = np.array([vector(t, terms) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, DIMS)
            score = vote(x, voters.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
