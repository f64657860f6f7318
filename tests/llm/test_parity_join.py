import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import parity_join as m


def brute(data, width=4, percent=85):
    sets = []
    for _, text in data:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(data, sets, strict=True))), key=str)


def table(seed=2, spread=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one", "One", "two words", "a b c d", "A b c d", "a b c d e"]
    for size in (12, 25, 60, 150, 400):
        b = [word() for _ in range(size)]
        for _ in range(30):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + max(1, size // spread))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            texts.append(" ".join(w))
        texts += [" ".join(b)] * 4
    shared = " ".join(word() for _ in range(60))
    texts += [f"{shared} {' '.join(word() for _ in range(rng.randrange(3, 40)))}" for _ in range(60)]
    rng.shuffle(texts)
    return list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))


def run(spark, data, percent=85):
    docs = spark.createDataFrame([(i, t, 1, "y", 3) for i, t in data], "doc_id long, text string, node int, key string, label int").repartition(3)
    found = m.components_of(docs, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=str)


def test_components_equal_all_pairs(spark):
    data = table(1)
    got = run(spark, data)
    assert got == brute(data) and 5 < len({r[2] for r in got}) < len(got) - 50


def test_small_blocks_busy_keys_and_cut_buckets(spark, monkeypatch):
    for name, value in (("BLOCK_NODES", 4), ("SPLIT", 0), ("BUSY", 3), ("BLOCK_BYTES", 3000)):
        monkeypatch.setattr(m, name, value)
    data = table(7, spread=5)
    long = " ".join(f"w{i % 7001}x{i % 13}" for i in range(40_000))
    data += [(20_000, long), (20_001, long + " end"), (20_002, long.upper())]
    assert run(spark, data) == brute(data)


def test_another_similarity(spark):
    data = table(9, spread=4)
    assert run(spark, data, 70) == brute(data, percent=70)


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(map(str, range(60)))
    data = [(None, text), (None, text), (5, text), (5, text), (None, "other"), (7, "x y"), (7, "z")]
    assert run(spark, data) == brute(data)
    assert run(spark, []) == []


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_words_in_one_band_and_stay_within_the_bits(percent):
    rng, cut = np.random.default_rng(5), m.edges(percent)
    tried = 0
    for size in [*range(2, 40), 57, 58, 99, 100, 311, 1000, 4093]:
        for _ in range(9):
            shared = int(rng.integers(max(1, size * percent // 100), size + 1))
            pool = rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64)
            one = np.unique(pool[:size])
            two = np.unique(np.r_[pool[:shared], pool[size : size + int(rng.integers(0, size - shared + 1)) + int(rng.integers(0, 3))]])
            both = len(np.intersect1d(one, two))
            apart = len(one) + len(two) - 2 * both
            bits = int(np.bitwise_count(m.fold(one) ^ m.fold(two)).sum())
            assert bits <= apart
            x, y = m.tall(one), m.tall(two)
            kept = list(m._no_further([pa.RecordBatch.from_pydict({"a": [1], "b": [2], "n": [len(one) + len(two)], "a_tall": pa.array([x], pa.binary()), "b_tall": pa.array([y], pa.binary())})], percent))[0].num_rows
            if 100 * both >= percent * (len(one) + len(two) - both) and apart:
                tried += 1
                assert kept == 1
                assert apart <= m.differ(len(one), len(two), percent)
                assert len(np.intersect1d(m.keys_of(one, cut, percent), m.keys_of(two, cut, percent))) >= m.SHARED
    assert tried > 40


def test_buckets_met_in_slices_give_the_components_of_the_whole(spark, monkeypatch):
    """No slice is dealt all rows of the open buckets, and counts of a pair add up over slices."""
    for name, value in (("BLOCK_NODES", 4), ("SPLIT", 0), ("SLICE_ROWS", 20)):
        monkeypatch.setattr(m, name, value)
    dealt, real = [], m.durable

    def counted(df, name):
        stored = real(df, name)
        if name == "parity-dealt":
            dealt.append(stored.count())
        return stored

    monkeypatch.setattr(m, "durable", counted)
    monkeypatch.setattr(m, "MOST_SLICES", 4)
    data = table(7, spread=5)
    assert run(spark, data) == brute(data)
    assert len(dealt) == 4 and max(dealt) < 0.6 * sum(dealt)


def test_nodes_that_share_four_open_buckets_meet_in_one_that_neither_leaves_out(spark):
    """Crowded buckets are left out by all nodes that have three more crowded ones or none, and no link goes with them."""
    rng = random.Random(3)
    held = {n: set(range(3)) | set(rng.sample(range(3, 40), rng.randrange(0, 9))) for n in range(60)}
    many = {k: sum(k in keys for keys in held.values()) for k in range(40)}
    open_ = spark.createDataFrame([(n, k, many[k]) for n, keys in held.items() for k in keys], "node long, key long, many long")
    limits = {r.node: (r.limit.many, r.limit.key) for r in m._limits(open_).collect()}
    kept = {n: {k for k in keys if n in limits and (many[k], k) <= limits[n]} for n, keys in held.items()}
    for a in held:
        assert len(kept[a]) == max(0, len(held[a]) - 3)
        for b in held:
            if a < b and len(held[a] & held[b]) >= m.SHARED:
                assert kept[a] & kept[b]
    # what all nodes have in common they no longer meet in
    assert not any(keys & set(range(3)) for keys in kept.values())


def test_large_sets_that_512_bits_cannot_part_are_parted_before_their_third_sketches_are_looked_up(spark):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    sets = [np.unique(pool[:5000]), np.unique(np.r_[pool[:4900], pool[10_000:10_100]]), np.unique(np.r_[pool[:1500], pool[20_000:23_500]]), np.unique(pool[:900])]
    nodes = spark.createDataFrame([(bytes([i]), len(s), m.fold(s).view("<i8").tolist(), None if (b := m.broad(s)) is None else b.tolist()) for i, s in enumerate(sets)], "node binary, n long, fold array<long>, broad array<long>")
    pairs = nodes.select(m.F.col("node").alias("a")).crossJoin(nodes.select(m.F.col("node").alias("b"))).filter("a < b")
    both = pairs.join(m._as(nodes.drop("broad"), "a"), "a").join(m._as(nodes.drop("broad"), "b"), "b")
    two = {(r.a[0], r.b[0]) for r in both.filter(m._may_link("a", "b", 85)).collect()}
    assert two == {(0, 1), (0, 2), (1, 2)}  # the sizes alone part a small set from the others
    assert {(r.a[0], r.b[0]) for r in m._broadly(pairs, nodes, 85).collect()} == {(0, 1), (0, 3), (1, 3), (2, 3)}


def test_texts_that_no_pair_asks_for_are_left_where_they_are(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "cast(id as string) text").withColumn("text_hash", m.F.xxhash64("text"))
    asked = {r.doc_id for r in m._asked(docs, docs.filter("doc_id % 100 = 0")).collect()}
    assert asked >= set(range(0, 5000, 100)) and len(asked) < 60


def test_what_links_is_told_by_the_last_listing_too(spark, monkeypatch):
    """Leaders verify nothing here, so every link is found by meeting in the buckets that nodes keep."""
    none = m._led
    monkeypatch.setattr(m, "_led", lambda *a: none(*a[:-1], m.F.lit(False)))
    data = table(4)
    assert run(spark, data) == brute(data)
