import random

import numpy as np

from graphloom.llm import near_dedup as n
from graphloom.llm.components import components


def brute(data):
    """doc index -> (set size, component as a set of indices), all pairs compared."""
    sets = []
    for _, text in data:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [len(s) for s in sets], [root(i) for i in range(len(data))]


def table(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(150)] for _ in range(4)]
    texts = [None, "", " \n", "one", "One", "two words", "a b c d", "A b c d", "a b c d e"]
    for b in base:
        for _ in range(45):
            w = list(b)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts += [" ".join(b)] * 5
    texts += [" ".join(word() for _ in range(rng.randrange(3, 80))) for _ in range(60)]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_components_equal_all_pairs(spark):
    data = table()
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, node int")
    sizes, roots = brute(data)
    least = {}
    for (i, _), r in zip(data, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, s, least[r], i == least[r]) for (i, _), s, r in zip(data, sizes, roots, strict=True))
    assert sorted(map(tuple, n.components_of(docs).collect())) == want
    kept = n.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(k for *_, k in want)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (None, "other"), (7, "x y"), (7, "z")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, n.components_of(docs).collect())))
    assert got == sorted(map(str, [(None, 56, 5, False), (None, 56, 5, False), (5, 56, 5, True), (5, 56, 5, True), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True)]))
    assert n.keep_documents(docs).count() == 4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert n.components_of(docs).collect() == []


def test_sketch_fills_and_concentrates():
    rng = np.random.default_rng(1)
    for size in (1, 2, 10, 500):
        assert n.sketch(rng.integers(0, 1 << 63, size, dtype=np.uint64)).max() < np.iinfo(np.uint64).max
    found = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
        found.append(np.mean(n.sketch(pool[:100]) == n.sketch(pool[30:])))
    assert abs(np.mean(found) - 70 / 130) < 0.02 and np.std(found) < 0.045


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(201)}


def test_components_of_a_large_star_with_chains(spark):
    links = spark.range(2000).selectExpr("5000L as a", "id as b").union(spark.range(1000).selectExpr("6000 + id * 2 as a", "6001 + id * 2 as b"))
    want = {(i, 0) for i in [*range(2000), 5000]} | {(i, i - i % 2) for i in range(6000, 8000)}
    assert {tuple(r) for r in components(links).collect()} == want


def test_links_at_the_bound_share_a_band_and_keep_within_the_bits():
    rng = np.random.default_rng(5)
    most, missed = 0, 0
    for shared, each in ((6, 0), (17, 0), (34, 3), (85, 0), (170, 15), (850, 75)):
        for _ in range(300):
            pool = rng.integers(0, 1 << 63, 2 * each + shared + max(1, (shared * 15 - 2 * each * 85) // 85), dtype=np.uint64)
            one, two = pool[: shared + each], np.concatenate([pool[:shared], pool[shared + each :]])
            if not n.linked(np.unique(one), np.unique(two)):
                continue
            a, b = n.sketch(np.unique(one)), n.sketch(np.unique(two))
            most = max(most, int(sum(int(x).bit_count() for x in (n.bits(a) ^ n.bits(b)).view(np.uint64))))
            missed += not (n.band_keys(a, 6) == n.band_keys(b, 6)).any()
    assert 0 < most <= n.most_bits(85) == 34 and not missed


def test_large_buckets_in_blocks_long_texts_and_any_column(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_NODES", 4)
    data = table(seed=7)
    long = " ".join(f"w{i % 7001}x{i % 13}" for i in range(150_000))
    data += [(20_000, long), (20_001, long + " end"), (20_002, long.upper())]
    docs = spark.createDataFrame([(i, t, 1, "y", 3) for i, t in data], "doc_id long, text string, _hash int, row string, label int")
    sizes, roots = brute(data)
    least = {}
    for (i, _), r in zip(data, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, s, least[r], i == least[r]) for (i, _), s, r in zip(data, sizes, roots, strict=True))
    assert sorted(map(tuple, n.components_of(docs).collect())) == want
    kept = n.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_, k in want if k)
    assert {(r["_hash"], r["row"], r["label"]) for r in kept.collect()} == {(1, "y", 3)}
