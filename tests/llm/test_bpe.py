import random

import public_tokenizers
import pytest

from graphloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = open(PATH, "rb").read()


def texts():
    rng = random.Random(7)
    parts = ["the", " of", "  ", "\n", "\n\n ", "'s", "'", "1234", " 9", "äöü", "🙂", "!!", "\t", "Don't", "x" * 90, " " * 80]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    return [None, "", " ", "a", "a" * 1500, " " * 1500, "a b" * 900, *made, made[0]]


@pytest.mark.parametrize("chunk,overlap", [(100, 20), (333, 64), (32768, 1024)])
def test_chunked_encoding_equals_plain(spark, chunk, overlap):
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts())], "doc_id long, text string, ids string, k int")
    got = sorted(map(tuple, bpe.digests(bpe.encode_documents(docs, PATH, PATTERN, chunk, overlap)).collect()), key=str)
    assert got == sorted(((i if i else None, *bpe.reference_digests(t, VOCABULARY, PATTERN)) for i, t in enumerate(texts())), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode_documents(docs, PATH, PATTERN)).collect() == []
