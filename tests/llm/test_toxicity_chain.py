import random

import numpy as np

from graphloom.llm import toxicity_chain as c

BAD = ["grub", "fie", "pox"]


def table(n=700, seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(2, 6)))
    data = []
    for i in range(n):
        words, good, toxic = [word() for _ in range(rng.randrange(5, 80))], rng.random() < 0.8, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        data.append((i, " ".join(rng.choice([w, w, w.capitalize() + ","]) if good else w + "%%%" for w in words), int(good), int(toxic)))
    return data


def test_held_out_verdicts(spark):
    data = table()
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in data] + [(None, None, "x"), (9000, "", "y"), (9001, "w" * 50_000, "z"), (9002, "b " * 30_000 + "POX", "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data if i % 4] + [(None, 1, 0), (8888, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in c.score_documents(docs, labels).collect()}
    assert len(rows) == len(data) + 4 and rows[9002].toxic and not rows[9000].toxic and not rows[None].toxic
    out = [(rows[i], q, x) for i, _, q, x in data if rows[i].held_out]
    assert np.mean([r.predicted == x for r, _, x in out]) > 0.97
    junk = [r.p_toxic_junk for r, q, x in out if x and not q]
    assert np.mean(junk) > 2 * np.mean([r.p_toxic_junk for r, q, x in out if not (x and not q)])
    assert all(r.score == r.p_toxic and r.toxic == (r.score >= c.THRESHOLD) for r in rows.values())


def test_the_verdict_comes_from_the_last_link(spark):
    data = table(400)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data], "doc_id long, quality int, toxic int")
    models = c.fit(docs, labels)
    assert c.CHAIN[-1] == "toxic" and np.abs(models[-1].odds).max() > 0.1
    terms = c.Terms()
    columns = [c.terms_of(t, terms) for _, t, *_ in data]
    at = np.repeat(np.arange(len(data)), [len(x) for x in columns])
    whole = c.predict(models, at, np.concatenate(columns), len(data))
    without = models[-1].logits(at, np.concatenate(columns), len(data), np.zeros((len(data), len(models) - 1)))
    assert np.abs(whole[:, -1] - c.sigmoid(without)).max() > 0.01
    rows = {r.doc_id: r.score for r in c.score_documents(docs, labels).collect()}
    # brute force: every term of every text, each model in turn
    assert all(abs(rows[i] - p) < 1e-9 for (i, *_), p in zip(data, whole[:, -1], strict=True))


def test_selection_is_optimal_and_refit_unshrunk():
    rng = np.random.default_rng(2)
    n = 800
    x = rng.random((n, 40)) < 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(2 - 4 * x[:, 3]))).astype(float)
    rows, columns = np.nonzero(x)
    model = c.train(rows, columns.astype(np.int32), n, np.zeros((n, 0)), y)
    assert model.columns.tolist() == [3]
    a, b = y[x[:, 3]].mean(), y[~x[:, 3]].mean()
    assert abs(model.weights[0] - (np.log(a / (1 - a)) - np.log(b / (1 - b)))) < 0.05


def test_later_models_use_earlier_odds():
    rng = np.random.default_rng(4)
    n = 1200
    x = rng.random((n, 6)) < 0.4
    first = (x[:, 0] ^ (rng.random(n) < 0.05)).astype(float)
    rows, columns = np.nonzero(x)
    chain = c.fit_chain(rows, columns.astype(np.int32), np.stack([first, first * x[:, 1]], 1), np.arange(n) % 4)
    assert [len(m.odds) for m in chain] == [0, 1] and (chain[1].odds[0] > 0 or 0 in chain[1].columns)
    p = c.predict(chain, rows, columns.astype(np.int32), n)
    assert np.mean((p[:, 1] > 0.5) == (first * x[:, 1] > 0)) > 0.9


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-3 for r in c.score_documents(docs, labels).collect())
    assert c.score_documents(docs.limit(0), labels).collect() == []
    assert len(c.terms_of(None, c.Terms())) == 0
