"""Toxicity categories by a classifier chain of sparse linear models.

The categories are predicted in a fixed order. Each is a logistic regression with an L1
penalty over the hashed words, word beginnings and word shapes that a text holds, and over
the log odds of all categories before it. While training, those odds come from models that have not seen
the row (out of fold), so later models learn from odds as uncertain as they will meet.

The labels give `toxic` and `quality`; the chain is: toxic in a text of low quality, toxic in
a text of good quality, toxic at all. The last link, fed by the odds of the others, is the
score. Models are fitted on a bounded labelled sample (`sample`), never on the held-out fold;
every document is scored on its whole text.

Null and empty texts have no terms and are scored by the intercepts. Repeated rows are
scored each. Without labels, or where a category has no case, its probability is 0. Extra
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small
from graphloom.llm.text_features import KNOWN_WORDS, bare_word, held_out, labelled_sample, shape

SAMPLE = 8_192
CHAIN = ("toxic_junk", "toxic_prose", "toxic")
FOLDS_OUT = 4
DEVIATIONS = 6.0
STEPS = 200
ENTRIES = 8
RIDGE = 0.05
#: A column needs this many rows, and this share of the rows of the category.
SUPPORT, SUPPORT_SHARE = 5, 0.02
THRESHOLD = 0.4
WORD_BITS = 22
SHAPE_BITS = 12
#: Lengths of word beginnings: stems tell what compounds hide.
PREFIXES = (4, 5, 6, 7)
#: How many words of a text must begin so, for a term of its own each.
TIMES = (1, 2, 3, 5)


class Terms(dict):
    """Term numbers of a word: itself, what it begins with, and its shape.

    With `wanted`, sorted, only those numbers whose term is among them, whatever its count.
    """

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        super().__init__()
        self.wanted = None if wanted is None else frozenset(_once(wanted).tolist())

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        bare = bare_word(text)
        number = lambda t: xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass"))
        begins = (number(bare[:k]) % (1 << WORD_BITS) + (1 << WORD_BITS) for k in PREFIXES if len(bare) >= k)
        value = (number(bare) % (1 << WORD_BITS), *begins, number(shape(text)) % (1 << SHAPE_BITS) + ((1 + len(TIMES)) << WORD_BITS))
        if self.wanted is not None:
            value = tuple(t for t in value if t in self.wanted)
        self[word] = value
        return value


def _once(numbers: np.ndarray) -> np.ndarray:
    """The numbers of terms, those of beginnings that are counted as for a count of one."""
    place = numbers >> WORD_BITS
    counted = (place > 1) & (place <= len(TIMES))
    return np.where(counted, numbers - ((place - 1) << WORD_BITS), numbers)


def terms_of(text: str | None, terms: Terms) -> np.ndarray:
    """The distinct term numbers of a text, in order; a beginning once more for each count it reaches."""
    words = Counter(text.encode("utf-8", "surrogatepass").split()) if text else {}
    if terms.wanted is not None:
        words = {w: n for w, n in words.items() if terms[w]}
    each = list(map(terms.__getitem__, words))
    every = np.fromiter(chain.from_iterable(each), np.int64)
    unique, where = np.unique(every, return_inverse=True)
    count = np.bincount(where, weights=np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(e) for e in each]), minlength=len(unique))
    begins = (unique >> WORD_BITS) == 1
    more = [unique[begins & (count >= n)] + (i << WORD_BITS) for i, n in enumerate(TIMES) if i]
    return np.concatenate([unique, *more]).astype(np.int32)


@dataclass
class Linear:
    """Weights of sorted term numbers, of the odds before in the chain, and an intercept."""

    columns: np.ndarray
    weights: np.ndarray
    odds: np.ndarray
    intercept: float

    def logits(self, rows: np.ndarray, columns: np.ndarray, n: int, odds: np.ndarray) -> np.ndarray:
        out = np.full(n, self.intercept)
        if len(self.columns):
            at = np.minimum(np.searchsorted(self.columns, columns), len(self.columns) - 1)
            hit = self.columns[at] == columns
            out += np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=n)
        return out + odds @ self.odds if len(self.odds) else out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ridge(x: np.ndarray, y: np.ndarray, weights: np.ndarray, strength: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton steps, with a light penalty on all but the intercept."""
    penalty = np.full(x.shape[1], strength)
    penalty[0] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ weights)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * weights)
        weights = weights + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(rows: np.ndarray, columns: np.ndarray, n: int, odds: np.ndarray, y: np.ndarray, deviations: float = DEVIATIONS) -> Linear:
    """Logistic regression on the terms that an L1 penalty selects.

    The penalty of a column is so many deviations of its gradient under chance. Columns
    enter while their gradient exceeds it, until none does, so the selection is the one of
    the optimum over all columns; the selected ones, the odds before and the intercept are
    then fitted again with a light ridge, free of the shrinkage.
    """
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(0, np.int32), np.zeros(0), np.zeros(odds.shape[1]), -30.0 if not len(y) or y.max() == 0 else 30.0)
    every, where = np.unique(columns, return_inverse=True)
    share = np.bincount(where, minlength=len(every)) / n
    penalty = deviations * np.sqrt(share * y.mean() * (1 - y.mean()) / n)
    penalty[share * n < max(SUPPORT, SUPPORT_SHARE * y.sum())] = np.inf
    active = np.zeros(0, np.int64)
    fixed = np.hstack([np.ones((n, 1)), odds])
    free = fixed.shape[1]
    weights = ridge(fixed, y, np.concatenate([[np.log(y.mean() / (1 - y.mean()))], np.zeros(free - 1)]))
    dense = fixed
    for _ in range(ENTRIES):
        slope = np.abs(np.bincount(where, weights=(sigmoid(dense @ weights) - y)[rows], minlength=len(every))) / n
        new = np.setdiff1d(np.flatnonzero(slope > penalty * (1 + 1e-3)), active)
        if not len(new):
            break
        active = np.concatenate([active, new[np.argsort(-(slope / penalty)[new], kind="stable")][:128]])
        place = np.full(len(every), -1)
        place[active] = np.arange(len(active))
        hit = place[where] >= 0
        x = np.zeros((n, len(active)))
        x[rows[hit], place[where[hit]]] = 1
        dense = np.hstack([fixed, x])
        weights = np.concatenate([weights, np.zeros(dense.shape[1] - len(weights))])
        v = np.ones(dense.shape[1])
        for _ in range(30):
            v = dense.T @ (dense @ (v / np.linalg.norm(v)))
        step = 4 * n / np.linalg.norm(v)
        look, t = weights.copy(), 1.0
        for _ in range(STEPS):
            nxt = look - step * (dense.T @ (sigmoid(dense @ look) - y)) / n
            nxt[free:] = np.sign(nxt[free:]) * np.maximum(np.abs(nxt[free:]) - step * penalty[active], 0)
            t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            look, weights = nxt + (was - 1) / t * (nxt - weights), nxt
    chosen = np.flatnonzero(weights[free:])
    final = ridge(dense[:, [*range(free), *(free + chosen)]], y, weights[[*range(free), *(free + chosen)]])
    order = np.argsort(every[active[chosen]])
    return Linear(every[active[chosen]][order], final[free:][order], final[1:free], float(final[0]))


def fit_chain(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model for each column of labels; earlier odds are predicted out of fold."""
    n, models, odds = len(labels), [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        models.append(train(rows, columns, n, odds, y))
        if c + 1 == labels.shape[1]:
            break
        out = np.zeros(n)
        for f in np.unique(folds):
            inside, kept = folds == f, folds != f
            renumber = np.cumsum(kept) - 1
            take, other = kept[rows], inside[rows]
            model = train(renumber[rows[take]], columns[take], int(kept.sum()), odds[kept], y[kept])
            back = np.cumsum(inside) - 1
            out[inside] = model.logits(back[rows[other]], columns[other], int(inside.sum()), odds[inside])
        odds = np.hstack([odds, np.clip(out, -8, 8)[:, None]])
    return models


def predict(models: list[Linear], rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The probability of each category, predicted in order."""
    odds = np.zeros((n, 0))
    for model in models:
        odds = np.hstack([odds, np.clip(model.logits(rows, columns, n, odds), -8, 8)[:, None]])
    return sigmoid(odds)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain from at most `sample` labelled documents."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in small(batches):
            held = [terms_of(t, terms).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label_toxic", "label_quality")), pa.array(held, pa.binary())], names=["doc_id", "toxic", "quality", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = labelled_sample(docs, labels, ["toxic", "quality"], sample).select("doc_id", "label_toxic", "label_quality", "text")
    got = chosen.mapInArrow(found, f"doc_id {kind}, toxic double, quality double, terms binary").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("toxic", "quality", "terms")]).collect()
    got.sort(key=lambda r: r["doc_id"])
    columns = [np.frombuffer(r["terms"], "<i4") for r in got]
    held = np.zeros(((1 + len(TIMES)) << WORD_BITS) + (1 << SHAPE_BITS), np.uint16)
    for c in columns:
        held[c] += 1
    columns = [c[held[c] >= SUPPORT] for c in columns]  # no model takes a column with fewer rows
    rows = np.repeat(np.arange(len(got), dtype=np.int32), [len(c) for c in columns])
    toxic, good = (np.array([r[c] >= 0.5 for r in got], bool) for c in ("toxic", "quality"))
    y = np.stack([toxic & ~good, toxic & good, toxic], axis=1).astype(float).reshape(-1, len(CHAIN))
    return fit_chain(rows, np.concatenate([np.zeros(0, np.int32), *columns]), y, np.arange(len(got)) % FOLDS_OUT)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (of toxic), predicted, toxic and the probability of each category."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(fit(docs, labels, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(np.unique(np.concatenate([m.columns for m in models.value])))
        for batch in small(batches):
            ids = batch.column("doc_id")
            columns = [terms_of(t, terms) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
            p = predict(models.value, rows, np.concatenate([np.zeros(0, np.int32), *columns]), len(columns))
            verdict = p[:, -1] >= threshold
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(p[:, -1], pa.float64()), pa.array(verdict.astype(np.int32), pa.int32()), pa.array(verdict, pa.bool_()), *(pa.array(p[:, i], pa.float64()) for i in range(len(CHAIN)))], names=["doc_id", "held_out", "score", "predicted", "toxic", *(f"p_{c}" for c in CHAIN)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int, toxic boolean, " + ", ".join(f"p_{c} double" for c in CHAIN))
