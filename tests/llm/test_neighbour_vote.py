import random

import numpy as np

from graphloom.llm import neighbour_vote as v
from graphloom.llm.text_features import Terms, held_out, shape


def table(n=300, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    data = []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(word() + ("" if good else rng.choice(["%%%", "***"])) for _ in range(rng.randrange(5, 90)))
        data.append((i, text, int(good)))
    return data


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, None, "x"), (9000, "", "y"), (9001, "w" * 50_000, "z"), data[0][:2] + ("x",)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 3] + [(None, 1, 0), (7777, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_exact_votes(spark):
    data = table()
    docs, labels = frames(spark, data)
    rows = v.score_documents(docs, labels).collect()
    assert len(rows) == len(data) + 4
    truth = {i: q for i, _, q in data}
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in rows)
    voters, terms = v.fit(docs, labels), Terms()
    text = {i: t for i, t, _ in data}
    for r in rows[:40]:
        x = v.vector(text.get(r.doc_id, ""), terms) @ voters.space
        near = sorted(((float(x @ y / max(1e-9, np.linalg.norm(x))), label) for y, label in zip(voters.vectors, voters.labels, strict=True)), reverse=True)[: v.NEIGHBOURS]
        weight = [max(0, s) ** v.SHARPNESS for s, _ in near]
        if r.doc_id in text:
            assert abs(r.score - sum(w * q for w, (_, q) in zip(weight, near, strict=True)) / sum(weight)) < 1e-3


def test_without_labels_or_documents(spark):
    docs, labels = frames(spark, table(20))
    assert {r.score for r in v.score_documents(docs, labels.limit(0)).collect()} == {v.PRIOR}
    assert v.score_documents(docs.limit(0), labels).collect() == []


def test_shapes():
    assert shape("Hello12%%%!") == "Aa0%!" and shape("ÉTÉ") == "A" and shape("|") == "|"
