import hashlib
import math
import random
import re
import zlib

import pytest

from graphloom.llm import importance as m

SHAPE = "doc_id long, text string, score string, rank string, n_words int"


def brute(docs, target, longest, percent=10, buckets=10_000, least=20):
    """The contract, word for word, on lists."""

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for text in docs:
        for f in features(text[1])[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def table(seed=3, n=400):
    rng = random.Random(seed)
    letters = ["the", "The", "alpha", "BETA", "čaj", "naïve", "x1", "42", "日本", "end", "a-b", "semi;colon", "tab\there", "line\nbreak", "ÀÉ", "I'm"]
    data = [(i, " ".join(rng.choice(letters) + rng.choice(["", "1", "s"]) for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    data += [(1000, None), (1001, ""), (1002, " .;\x00 "), (None, data[3][1]), (5, data[5][1]), (5, data[5][1]), (7, data[9][1]), (1003, " ".join(f"w{i}" for i in range(40_000)))]
    rng.shuffle(data)
    return data, ["the alpha alpha tea čaj", None, "", "日本 42 the end"] * 3


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_the_contract(spark, longest, monkeypatch):
    data, target = table()
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in data], SHAPE).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in m.resample(docs, goal, longest=longest).collect()), key=str)
    assert got == brute(data, target, longest)
    assert sum(r[4] is not None for r in got) > 20


def test_tries_that_are_emptied_lose_nothing():
    trie, whole = m.Trie(2), m.Trie(2)
    import numpy as np

    run, parts, once = m.words("a b a b c d a b " * 50), np.zeros(97, np.int64), np.zeros(97, np.int64)
    for begin in range(0, len(run), 7):
        trie.walk(run, begin, min(len(run), begin + 7))
        trie.add_to(parts)
        trie.clear()
    whole.walk(run, 0, len(run))
    whole.add_to(once)
    assert (parts == once).all() and once.sum() == m.n_features(len(run), 2)
    assert {n.crc for n in whole.root.after[b"a"].after.values()} == {zlib.crc32(b"a b")}


def test_all_ties_and_every_percent(spark):
    docs = spark.createDataFrame([(None, "w " * 30)] * 7 + [(1, "w " * 30)] * 3, "doc_id long, text string")
    goal = spark.createDataFrame([("w",)], "text string")
    got = m.resample(docs, goal, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert all(r["rank"] for r in m.resample(docs, goal, percent=100).collect())
    assert not any(r["rank"] for r in m.resample(docs, goal, percent=0).collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert m.resample(none, some).collect() == []
    assert [tuple(r) for r in m.resample(some, none, percent=100).collect()] == brute([(1, "one two " * 20)], [], 1, percent=100)
