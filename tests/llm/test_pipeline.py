import collections
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers

from graphloom.llm import bpe, mixing, near_dedup, quality_rules, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(n=260, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    data = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60, 160))]
        if i % 9 == 0:
            words[5] = "token=" + "k3" * 10
        if i % 7 == 0:
            words = [w + "%%%$$" for w in words]
        data.append([i, " ".join(words), "en", rng.choice("ab"), 0])
    data += [[1000 + i, data[i + 1][1] + " tail", "en", "a", 0] for i in range(0, 40, 7)]
    data += [[2000, None, None, None, None], [2001, "", "en", "a", 0]]
    return [(*r[:4], len(r[1]) if r[1] is not None else None) for r in data]


def test_stages_follow_each_other(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long")
    start = {r.doc_id: r for r in docs.collect()}
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.durable(stage(spark, now, ""), name)
        seen.append(now.collect())
        assert name == "encode" or now.columns == COLUMNS
    quality, near, secrets, mix, encoded = seen
    kept = {r.doc_id for r in quality_rules.judge(docs, "doc_id").filter("kept").collect()}
    assert {r.doc_id for r in quality} == kept and all(i in kept for i in range(260) if i % 7) and not any(i in kept for i in range(0, 260, 7))
    assert {r.doc_id for r in near} == {i for i in kept if i < 1000}
    for r in secrets:
        text, spans = start[r.doc_id].text, secret_scan.reference(start[r.doc_id].text)
        assert (r.text == text) == (not spans) and "k3k3" not in r.text and r.n_chars == len(r.text)
    words = {r.doc_id: len(r.text.split()) for r in secrets}
    total, by = collections.Counter(), collections.Counter()
    for r in secrets:
        total[r.source] += words[r.doc_id]
    for r in mix:
        by[r.source] += words[r.doc_id]
    share = {s: min(2 * n, 1.5 * sum(total.values()) * w / 4) for (s, n), w in zip(sorted(total.items()), (3, 1), strict=True)}
    left = 1.5 * sum(total.values()) - sum(share.values())
    goal = {s: min(2 * total[s], n + left) for s, n in share.items()}
    assert all(abs(by[s] - goal[s]) <= 200 for s in goal)
    assert max(collections.Counter(r.doc_id for r in mix).values()) <= mixing.MOST
    vocabulary = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    text = {r.doc_id: r.text for r in secrets}
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mix)
    for r in encoded:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == bpe.reference_digests(text[r.doc_id], vocabulary, public_tokenizers.PATTERN)
        assert hashlib.sha256(__import__("base64").b64decode(r.ids)).hexdigest() == r.ids_sha256
    assert quality_rules.LEAST_WORDS == 50 and np.isfinite(len(encoded))


def test_clashing_columns_nulls_and_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(80_000)) + " token=abcdefgh1234"
    data = [(*r, 1, "s", 2, "t", 3, 4) for r in [*table(60), (3000, long, None, None, None), (3000, long, None, None, None), (None, None, "en", "a", 0)]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _tag int, spans string, _copies int, row string, label int, slot int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.durable(stage(spark, docs, ""), name)
        assert docs.columns == before.columns
        assert {tuple(r)[5:] for r in docs.collect()} == {(1, "s", 2, "t", 3, 4)}
    assert sum(r.doc_id == 3000 for r in docs.collect()) in (1, 2) and all("abcdefgh1234" not in r.text for r in docs.collect())
    encoded = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(encoded) == docs.count()


def test_run_leaves_its_last_table_only(spark, tmp_path):
    spark.createDataFrame(table(80), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from graphloom import durable as d

    d.release(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert d._WRITTEN[spark.sparkContext.applicationId] == [got.path] and got.count() > 0
    assert d.release(spark) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_copies_of_similarity_between_80_and_85_go(spark):
    rng = random.Random(6)
    data = []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        # two changed words apart touch ten of 100 shingles: 90 of 110 are shared
        near = ["x" if j in (30, 70) else w for j, w in enumerate(words)]
        data += [(i, " ".join(words)), (100 + i, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(30))
    assert near_dedup.keep_documents(docs).count() == 60
    assert near_dedup.band_rows(85) == 6 and near_dedup.band_rows(80) == 5
