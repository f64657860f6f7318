import collections
import math
import random

import numpy as np

from graphloom.llm import brown_lm as b


def table(n=260, seed=8):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        kind = rng.choice("AB")
        words = [f"{kind if j % 2 else 'z'}{rng.randrange(6)}" for j in range(rng.randrange(3, 40))]
        words += [f"rare{rng.randrange(5000)}"]
        data.append((i, " ".join(words)))
    return [*data, (None, "A1 z1"), (1000, None), (1001, ""), (1002, "x" * 20000), *data[:2]]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(data):
    c = collections.Counter(w for i, t in data if not b.held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (b.held_out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in data}, c


def test_counts_and_base_equal_brute_force(spark):
    data = table()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, score string, classes int")
    got = collections.defaultdict(list)
    for r in b.score_documents(docs, rounds=3).collect():
        got[r.doc_id].append(r)
    want, _ = brute(data)
    assert sum(map(len, got.values())) == len(data)
    for (i, _), (out, n, known, train, base) in want.items():
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, train)
            assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score <= 0
    short = [r for own in got.values() for r in own if r.n_tokens < 100]
    level = lambda rows, c: sum(r[c] for r in rows) / sum(r.n_tokens for r in rows)
    # texts that the model has not seen are less likely to it, and still likelier than by counts alone
    assert level([r for r in short if r.held_out], "score") < level([r for r in short if not r.held_out], "score")
    assert level([r for r in short if r.held_out], "score") > level([r for r in short if r.held_out], "base_score")


def learnt(spark, data, **options):
    """The model, and the class of every word, read off the texts' codes."""
    docs = spark.createDataFrame([(i, t) for i, t in data], "doc_id long, text string")
    model, told, _ = b.fit(b.coded_texts(docs), **options)
    codes = {r.doc_id: list(r.classes) for r in told.filter("classes is not null").collect()}
    class_of = {w: c for i, t in data for w, c in zip(tokens(t), codes[i], strict=True)}
    return model, class_of


def unseen_words(counts):
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    return max(once * (once - 1) / (2 * (twice + 1)), once, 1)


def test_scores_are_the_sum_of_steps_and_words(spark):
    data = [(i, t) for i, t in table() if i is not None][:-2]
    model, class_of = learnt(spark, data, rounds=2)
    _, counts = brute(data)
    end, new = model.steps.shape[1] - 2, model.steps.shape[1] - 1
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.score for r in b.score_documents(docs, rounds=2).collect()}
    for i, t in data:
        score, at = 0.0, end
        for w in tokens(t):
            to = class_of[w] if counts[w] else new
            score += model.steps[at, to] + (0 if w is None else math.log10(counts[w]) if counts[w] else 0)
            at = to
        assert abs(got[i] - score) < 1e-3 * max(1, -score)


def test_probabilities_of_all_words_add_up_to_one_at_most(spark):
    data = [(i, t) for i, t in table() if i is not None][:-2]
    model, class_of = learnt(spark, data, rounds=3, most=4)
    _, counts = brute(data)
    unseen = unseen_words(counts)
    assert abs(model.vocabulary.unseen - unseen) < 1e-6
    # of all words, those held out included, no more are unseen than the model allows for
    assert len({w for i, t in data for w in tokens(t) if not counts[w]}) <= unseen
    # emissions within each class of seen words add up to one
    by = collections.Counter()
    for w, n in counts.items():
        if n and w is not None:
            by[class_of[w]] += n
    assert all(by[c] == model.sums[c] for c in by) and set(by) <= set(range(4))
    p = 10**model.steps
    for at in range(len(p)):
        total = sum(p[at, c] * by[c] for c in by) + p[at, -2] + p[at, -1] * unseen
        assert 0.2 < total <= 1 + 1e-9
    full = (p[:, :-1] * np.where(np.arange(p.shape[1] - 1) == p.shape[1] - 2, 1, np.maximum(model.sums, 1))).sum(1) + p[:, -1] * unseen
    assert np.allclose(full, 1)


def test_a_move_gains_what_it_says():
    rng = np.random.default_rng(0)
    words, k = 12, 5
    pairs = rng.integers(0, 9, (words, words)).astype(float)
    classes = rng.integers(0, k, words)

    def level(classes):
        m = np.zeros((k, k))
        for i in range(words):
            for j in range(words):
                m[classes[i], classes[j]] += pairs[i, j]
        return m, m.sum(1)

    # as in a text, each word is left as often as it is entered
    pairs = (pairs + pairs.T) / 2
    m, s = level(classes)
    for w in range(words):
        right, left = (np.bincount(classes, weights=x, minlength=k) for x in (pairs[w], pairs[:, w]))
        to, gain = b.best_move(right, left, pairs[w, w], pairs[w].sum(), int(classes[w]), m, s, k)
        gains = []
        for c in range(k):
            moved = classes.copy()
            moved[w] = c
            gains.append(b.likelihood(*level(moved)) - b.likelihood(m, s))
        assert abs(gain - max(gains)) < 1e-6 and abs(gains[to] - max(gains)) < 1e-6


def test_dealt_words_take_the_best_move():
    rng = np.random.default_rng(1)
    same = total = 0
    for turn in range(400):
        c, most = 9, 6
        home = int(rng.integers(0, c - 1))
        right, left = rng.integers(0, 40 if turn % 9 == 0 else 4, (2, c)) * rng.integers(0, 2, (2, c))
        if turn % 2:
            right[home] = left[home] = 0  # no word of its own class beside it: exact
        own = int(min(right[home], left[home], rng.integers(0, 2)))
        matrix = rng.integers(0, 60, (c, c)).astype(float) + 40
        matrix[home] += right
        matrix[:, home] += left
        sums = matrix.sum(0) + 20
        to, _ = b.best_move(right.astype(float), left.astype(float), own, float(right.sum()), home, matrix, sums, most)
        got = int(b.Gains(matrix, sums, most).best(right[None], left[None], np.array([own]), np.array([right.sum()]), np.array([home]))[0])
        assert got == to or not turn % 2
        same, total = same + (got == to), total + 1
    assert same > 0.9 * total


def test_empty(spark):
    assert b.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(i, "never trained on") for i in range(40) if b.held_out(i)], "doc_id long, text string")
    rows = b.score_documents(only).collect()
    assert rows and all(r.held_out and r.n_known == 0 and np.isfinite(r.score) and r.score < 0 for r in rows)


def test_words_of_small_share_are_clustered(spark, monkeypatch):
    # with a share that few words reach, the others must still find the classes of their kind
    monkeypatch.setattr(b, "SHARE", 0.05)
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(("the", "a")) + f" n{rng.randrange(40)} " + rng.choice(("is", "was")) + f" v{rng.randrange(40)}" for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    levels = {}
    for deals in (0, 1, 2):
        rows = b.score_documents(docs, rounds=3, deals=deals).collect()
        assert len(rows) == len(data)
        levels[deals] = sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert levels[1] > levels[0] + 0.05 and levels[2] > levels[1] - 0.02
    model, class_of = learnt(spark, data, rounds=3)
    assert model.vocabulary.later_words == 80 and set(class_of.values()) <= {*range(b.CLASSES), b.CLASSES + b.SHAPES}
    # nouns and verbs hardly share a class
    of = {x: collections.Counter(class_of[f"{x}{i}".encode()] for i in range(40)) for x in "nv"}
    assert sum((of["n"] & of["v"]).values()) <= 20
