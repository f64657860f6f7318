import random
import zlib

import pytest

from graphloom.llm import sharding, splitters


def check(rows, shards):
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for shard, own in by.items():
        assert 0 <= shard < shards
        assert sorted(r.slot for r in own) == list(range(len(own)))
    largest = max(r.size for r in rows)
    for shard in range(shards):
        assert abs(sum(r.size for r in by.get(shard, [])) - total / shards) <= 2 * largest


def test_shards_are_equal_and_gapless(spark):
    data = [(None if i % 50 == 0 else i, None if i % 97 == 0 else ("same" if i % 3 == 0 else f"text {i} " * (1 + i % 40)), "x", i) for i in range(3000)]
    data += data[:5] * 300
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string, _tag int")
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == len(data)
    check(rows, 8)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in data)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_equal_texts_stay_together_where_they_fit(spark):
    docs = spark.createDataFrame([(i, f"t{i // 4}" * 30) for i in range(2000)] + [(9000 + i, f"long {i} " * 400) for i in range(5)], "doc_id long, text string")
    split = {}
    for r in sharding.shard_documents(docs, 5).collect():
        split.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in split.values())


def test_places_equal_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "", "twice", "a longer text that often comes " * 4, f"own {i} " * rng.randrange(1, 60)])) for i in range(900)] + [(5000, "word " * 40_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) h").collect()}
    size = {i: len((t or "").encode()) + 16 for i, t in data}
    shards, total = 7, sum(size.values())
    most, want, at, groups = max(*size.values(), int(0.01 * total / 7)), {}, 0, {}
    for i in sorted(size, key=lambda i: (hashes[i], i)):
        groups.setdefault(hashes[i], []).append(i)
    first = {}
    for row, (h, i) in enumerate((h, i) for h, own in groups.items() for i in own):
        own = groups[h]
        whole = sum(size[j] for j in own)
        begin = at - sum(size[j] for j in own[: own.index(i)])
        middle = begin + whole // 2 if len(own) > 1 and whole <= most else at + size[i] // 2
        shard = min(shards - 1, middle * shards // total)
        want[i] = (shard, row - first.setdefault(shard, row))
        at += size[i]
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs, shards).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(i, "a") for i in range(n)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 40).collect()
    assert len(rows) == n and len({(r.shard, r.slot) for r in rows}) == n


def test_ranges_subdivide_a_hot_key(spark):
    df = spark.range(4000).selectExpr("case when id < 3000 then 5L else id end as a", "id as b", "10L as size")
    cut = splitters.ranges(df, ["a", "b"], "size", 64)
    assert sum(n for _, n in cut.totals) == 4000
    assert max(s for s, _ in cut.totals) <= 4 * 40_000 / 64
