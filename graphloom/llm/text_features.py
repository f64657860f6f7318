"""Hashed terms of texts: words without their punctuation, and shapes of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_crc, id_crc_column

FOLDS, HELD_OUT = 4, 2
KNOWN_WORDS = 300_000

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_UPPER, _LOWER, _DIGIT, _RUN = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"[^\W\d_A]"), re.compile(r"\d"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters by case and digits by class, other characters kept, runs as one."""
    return _RUN.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))[:12]


class Terms(dict):
    """Two hashes of a word, of its bare lower-case form and of its shape, packed in one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        value = self[word] = xxhash.xxh32_intdigest(bare_word(text).encode("utf-8", "surrogatepass")) << 31 | xxhash.xxh32_intdigest(shape(text).encode("utf-8", "surrogatepass")) >> 1
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The packed hashes of the words of a text, in order."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bare_word(text: str) -> str:
    """A word without the punctuation around it, in lower case."""
    return _EDGE.sub("", text).lower()


def bare(packed: np.ndarray) -> np.ndarray:
    return packed >> 31


def shapes(packed: np.ndarray) -> np.ndarray:
    return packed & ((1 << 31) - 1)


def held_out(doc_id: object) -> bool:
    """Rows whose labels no model may see."""
    return id_crc(doc_id) % FOLDS == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """doc_id, text and mean labels of at most `most` labelled ids, those of least hash.

    Only rows outside the held-out fold, with an id and every label. The ids are a bounded
    list, so they are broadcast; a document that repeats may come more than once.
    """
    fold = F.pmod(id_crc_column(), F.lit(FOLDS)) != HELD_OUT
    known = labels.filter(fold & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.avg(c).alias(f"label_{c}") for c in columns]).dropna()
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
