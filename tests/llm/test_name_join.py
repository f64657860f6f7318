import random
import zlib

import numpy as np

from graphloom.llm import name_join as m

CLIENT = "client_id long, name string, key int, distance string, n_clients int"
VENDOR = "vendor_id long, name string, part int, size string"


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def misspelt(vendor_id, name):
    h = zlib.crc32(str(vendor_id).encode())
    if vendor_id is None or h % 2 or len(name) < 2:
        return name
    at = h % (len(name) - 1)
    return name[:at] + name[at + 1] + name[at] + name[at + 2 :]


def brute(clients, vendors):
    out = {}
    for v, name in vendors:
        if not name:
            continue
        spelt = misspelt(v, name)
        for c, other in clients:
            if other and abs(len(other) - len(spelt)) <= 2 and (d := osa(spelt, other)) <= 2:
                n, first, crc = out.get((v, d), (0, None, None))
                out[v, d] = (n + 1, c if first is None else first if c is None else min(first, c), crc if c is None else (crc or 0) + zlib.crc32(str(c).encode()))
    return sorted(((v, d, *rest) for (v, d), rest in out.items()), key=str)


def edited(rng, name, edits):
    for _ in range(edits):
        kind, at = rng.randrange(4), rng.randrange(len(name) + 1)
        if kind == 0:
            name = name[:at] + rng.choice("abcé") + name[at:]
        elif kind == 1:
            name = name[:at] + name[at + 1 :]
        elif kind == 2:
            name = name[:at] + rng.choice("abcé") + name[at + 1 :]
        elif at + 1 < len(name):
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    return name


def tables(seed, n=260):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé 𝒳") for _ in range(size)) for size in [*range(1, 34), 47, 60] for _ in range(2)]
    clients = [(i, edited(rng, rng.choice(base), rng.randrange(5))) for i in range(n)]
    vendors = [(i, edited(rng, rng.choice(base), rng.randrange(3))) for i in range(n)]
    return clients, vendors


def run(spark, clients, vendors):
    c = spark.createDataFrame([(i, t, 1, "d", 2) for i, t in clients], CLIENT).repartition(3)
    v = spark.createDataFrame([(i, t, 3, "s") for i, t in vendors], VENDOR).repartition(2)
    found = m.join_names(c, v)
    assert found.columns == ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    return sorted(map(tuple, found.collect()), key=str)


def test_every_pair_at_every_length(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    for seed in (1, 2):
        clients, vendors = tables(seed)
        got = run(spark, clients, vendors)
        assert got == brute(clients, vendors) and {r[1] for r in got} == {0, 1, 2} and len(got) > 200


def test_distances_in_bulk():
    rng = random.Random(4)
    pairs = []
    while len(pairs) < 3000:
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        b = edited(rng, a, rng.randrange(5))
        if b and abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    got = m.distances(m._codes(a), np.array(list(map(len, a))), m._codes(b), np.array(list(map(len, b))))
    assert got.tolist() == [min(3, osa(x, y)) for x, y in pairs]


def test_nulls_repeats_ties_and_long_names(spark):
    long = "".join(chr(0x4E00 + i % 977) for i in range(20_000))
    clients = [(None, "Anna Bell"), (3, "Anna Bell"), (3, "Anna Bell"), (4, None), (5, ""), (6, long[:-1] + "x"), (7, "A"), (8, "ab"), (9, "\x00\x00a\x00")] + [(100 + i, "Anna Bell") for i in range(30)]
    vendors = [(None, "Anna Bell"), (1, "Anna Bell"), (1, "Anna Bell"), (2, None), (9, ""), (3, long), (12, "B"), (13, "\x00\x00a\x00"), (14, "ba")]
    got = run(spark, clients, vendors)
    assert (3, 1, 1, 6, zlib.crc32(b"6")) in got
    short = [(c, t if t != long[:-1] + "x" else "") for c, t in clients]
    assert [r for r in got if r[0] != 3] == brute(short, vendors)


def test_no_pair_and_empty_tables(spark):
    assert run(spark, [(1, "abcdefghijkl")], [(1, "zzzzzzzzzzzz")]) == []
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []
