import random

from graphloom.llm import mixing


def filled(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets by filling again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        new = [s for s in rest if level * w[s] > most * sizes[s]]
        if not new:
            return full | {s: level * w[s] for s in rest}
        for s in new:
            full[s] = most * sizes[s]
            left -= full[s]


def table(n=1500, seed=3):
    rng = random.Random(seed)
    return [(None if i % 70 == 0 else i, None if i % 91 == 0 else " ".join(["w"] * rng.randrange(0, 120)), rng.choice(["a", "a", "a", "b", "Z", "é", None]), i) for i in range(n)]


def test_targets_and_taken(spark):
    data = table() + table()[:3] * 40
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == len(data)
    sizes = {}
    for _, text, source, _ in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes)
    by = {}
    source_of = {}
    for d, t, s, _ in data:
        source_of[d] = s
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            s = source_of[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert sorted({round(r.target, 6) for r in rows}) == sorted({round(x, 6) for x in want.values()})
    for r in rows:
        by[r.target] = by.get(r.target, 0) + r.taken
    for target, taken in by.items():
        assert abs(taken - target) <= 0.02 * target + 100


def brute(sized, weights=(3, 1, 2), budget=1.5, most=2):
    """taken and slots of every document, slot by slot. sized: (doc_id, source, size, h)."""
    sizes = {}
    for _, source, size, _ in sized:
        sizes[source] = sizes.get(source, 0) + size
    goal = filled(sizes, weights, budget, most)
    names = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if sizes[s] > 0]
    blocks = {s: max(-(-sizes[s] // mixing.BLOCK), min(sizes[s], mixing.LEAST_BLOCKS)) for s in names}
    exact = {s: goal[s] / (sizes[s] / blocks[s]) for s in names}
    ends, upto = {}, 0.0
    for s in names:
        upto += exact[s]
        ends[s] = mixing.UNIT if s == names[-1] else round(upto / sum(exact.values()) * mixing.UNIT)
    want, slots = {s: round(exact[s]) for s in names}, round(sum(exact.values()))
    order, got = [], dict.fromkeys(names, 0)
    for k in range(slots):
        u = k * mixing.GOLDEN % mixing.UNIT
        s = next(s for s in names if u < ends[s])
        if got[s] < want[s]:
            order.append((k, s, got[s]))
        got[s] += 1
    ranks = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    last = max(ranks[s] for s in names) + 1
    order += [(slots + (r - got[s]) * last + ranks[s], s, r) for s in names for r in range(got[s], want[s])]
    at = {}
    for k, s, rank in order:
        if rank // blocks[s] < most:
            at.setdefault((s, rank % blocks[s]), []).append(k)
    out = {}
    for s in names:
        begin = 0
        for i, _, size, _ in sorted((d for d in sized if d[1] == s), key=lambda d: (d[3] % (1 << 64) >> 54, d[3], d[0])):
            taken, seen = 0, {}
            for b in range(begin * blocks[s] // sizes[s] - 1, (begin + size) * blocks[s] // sizes[s] + 2):
                words = min(begin + size, (b + 1) * sizes[s] // blocks[s]) - max(begin, b * sizes[s] // blocks[s])
                if words > 0:
                    held = sorted(at.get((s, b), []))
                    taken += words * len(held)
                    for turn, k in enumerate(held):
                        seen[turn] = min(k, seen.get(turn, k))
            out[i] = (taken, seen.get(0), seen.get(1))
            begin += size
    return {i: out.get(i, (0, None, None)) for i, *_ in sized}


def test_every_document_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 40)
    monkeypatch.setattr(mixing, "BLOCK", 600)
    data = [r for r in table(700) if r[0] is not None]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n int")
    sized = [(r.doc_id, r.source, r["size"], r.h) for r in mixing.sizes(docs, "doc_id").collect()]
    assert {r.doc_id: (r.taken, r.first_slot, r.second_slot) for r in mixing.taken_words(docs).collect()} == brute(sized)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(table(400), "doc_id long, text string, source string, n int")
    a = sorted(map(str, mixing.taken_words(docs).collect()))
    assert a == sorted(map(str, mixing.taken_words(docs.repartition(7)).collect()))


def test_schedule_interleaves(spark):
    docs = spark.createDataFrame(table(600), "doc_id long, text string, source string, n int")
    _, slots = mixing.mix(mixing.sizes(docs, "doc_id"))
    rows = slots.orderBy("slot").collect()
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(r.s, []).append((i, r["rank"]))
    for own in names.values():
        assert [k for _, k in own] == list(range(len(own)))
        share = len(own) / len(rows)
        assert all(abs(k + 1 - share * (i + 1)) < 8 for i, k in own)


def test_documents_follow_the_mix(spark):
    docs = spark.createDataFrame(table(500), "doc_id long, text string, source string, n int")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[r.n] = count.get(r.n, 0) + 1
    assert max(count.values()) <= 2


def test_slots_decide_the_order_of_the_mix(spark):
    data = [(i, " ".join(["w"] * 20), rng_source) for i, rng_source in enumerate("aab" * 200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.taken_words(docs).collect()}
    assert all((r.first_slot is not None) == (r.taken > 0) and (r.second_slot is not None) == (r.taken > r.size) for r in rows.values())
    # every document's first slot is the least slot whose block holds a word of it
    _, slots = mixing.mix(mixing.sizes(docs, "doc_id"))
    assert min(r.first_slot for r in rows.values() if r.taken) == slots.agg({"slot": "min"}).first()[0]
    order = [r.doc_id for r in mixing.mix_documents(docs).collect()]
    due = sorted((slot, d) for d, r in rows.items() for slot in (r.first_slot, r.second_slot)[: (r.taken + r.size // 2) // r.size])
    place = {}
    for slot, d in due:
        place.setdefault(d, []).append(slot)
    seen = [place[d].pop(0) for d in order]
    assert seen == [slot for slot, _ in due] and not any(place.values())
    # so every stretch of the mix has nearly the shares of the whole
    source = {i: s for i, _, s in data}
    share = sum(source[d] == "b" for d in order) / len(order)
    for begin in range(0, len(order) - 100, 100):
        assert abs(sum(source[d] == "b" for d in order[begin : begin + 100]) / 100 - share) < 0.08


def test_stage_keeps_columns_of_any_name_and_rows_of_equal_keys(spark):
    data = [(1, "a b c", "x", 1, 2, 3), (1, "a b c", "x", 4, 5, 6), (None, None, None, 7, 8, 9), (2, "w " * 90_000, "x", 0, 0, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _tag int, _copies int, slot int")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r["_tag"], r["_copies"], r["slot"]) for r in mixed.collect()} <= {x[3:] for x in data}
    assert any(r.doc_id is None for r in mixed.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken_words(docs).collect() == [] and mixing.mix_documents(docs).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.taken_words(none).collect()] == [(0, 0), (0, 0)]


def test_small_sources_reach_their_targets_beside_large_ones(spark, monkeypatch):
    # blocks larger than a small source
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 64)
    sized = spark.createDataFrame([(f"L{i:02d}", j, 50_000) for i in range(20) for j in range(20)] + [(f"S{i:03d}", j, 100) for i in range(100) for j in range(30)], "source string, id long, size long")
    taken, _ = mixing.mix(sized.withColumn("h", mixing.F.xxhash64("source", "id")))
    got = {}
    for r in taken.collect():
        size, target, words = got.get(r.source, (r.source_size, r.target, 0))
        got[r.source] = (size, target, words + r.taken)
    assert len(got) == 120
    for size, target, words in got.values():
        assert abs(words - target) <= max(size / 64, mixing.BLOCK)
        assert abs(words - target) <= 0.02 * target


def test_points_are_exact(spark):
    ids = [0, 1, 2, 12345, 46_368, (1 << 20) + 1, (1 << 32) - 1, (1 << 40) + 7, (1 << 61) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing._point(mixing.F.col("id")).alias("u")).collect()
    assert {r.id: r.u for r in rows} == {i: i * mixing.GOLDEN % mixing.UNIT for i in ids}
