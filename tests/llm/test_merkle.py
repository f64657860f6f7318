import base64
import collections
import hashlib
import random

from graphloom.llm import merkle as m


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) + rng.choice(["", "", "", ".\n"]) for _ in range(n))


def test_leaves_cover_the_text_and_likeness_follows_edits():
    rng = random.Random(3)
    for n in (0, 1, 30, 900):
        text = prose(rng, n)
        assert "".join(m.paragraphs(text)) == text and m.tree(text).size == len(text)
        assert m.likeness(m.tree(text), m.tree(text)) == 1
    a = prose(rng, 2000)
    b = a[:3000] + "EDIT" + a[3010:]
    assert m.likeness(m.tree(a), m.tree(b)) > 0.95
    alone = m.differing(m.tree(a), m.tree(b))
    assert 0 < len(alone[0]) < 5 and 0 < len(alone[1]) < 5
    assert m.likeness(m.tree(a), m.tree(prose(rng, 2000))) < 0.1
    half = m.likeness(m.tree(a), m.tree(m.edit(a, prose(rng, 2000))))
    assert 0.4 < half < 0.6
    assert m.fingerprint("a b") != m.fingerprint("a  b") and m.likeness(m.tree("x" * 100_000), m.tree("")) == 0


def levels(text):
    """The digests and weights of all levels, from the leaves up, by plain hashing."""
    sha = lambda data: hashlib.sha256(data).digest()[:16]
    found = [[(sha(b"\0" + p.encode()), len(p)) for p in m.paragraphs(text)]]
    while len(found) == 1 or len(found[-1]) > 1:
        groups, held = [], []
        for node in found[-1]:
            held.append(node)
            if len(held) == 64 or (len(held) > 1 and node[0][-1] % 8 == 0):
                groups.append(held)
                held = []
        groups += [held] if held or not groups else []
        found.append([(sha(b"\1" + b"".join(d for d, _ in g) + b"".join(w.to_bytes(8, "little") for _, w in g)), len(g)) for g in groups])
    return found


def written(text):
    found = levels(text)
    return found[-1][0][0].hex() + "|" + ",".join(str(w) for _, w in found[0]) + ":" + base64.b64encode(b"".join(d for d, _ in found[0])).decode()


def shared(a, b):
    """Twice the common leaves over all, counted without a tree."""
    one, two = (collections.Counter(m.paragraphs(x)) for x in (a, b))
    every = len(a) + len(b)
    return 2 * sum(len(p) * n for p, n in (one & two).items()) / every if every else 1.0


def want(data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(order):
        following, own = order[(i + 1) % len(order)][1] or "", text or ""
        edited = m.edit(own, following)
        marks = [written(x) for x in (own, edited)]
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), *marks, shared(own, edited), shared(own, following)))
    return sorted(out, key=str)


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(i * 7 % 1009, rng.choice([None, "", "é🙂" * 9, prose(rng, rng.randrange(1, 120))])) for i in range(400)] + [(None, "none")]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, _range string").repartition(5)
    got, expected = sorted(map(tuple, m.fingerprints(docs).collect()), key=str), want(data)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert all(abs(x - y) < 1e-12 for a, b in zip(got, expected, strict=True) for x, y in zip(a[5:], b[5:], strict=True))


def test_a_root_follows_from_children_and_covers_every_leaf():
    rng = random.Random(7)
    for n in (0, 1, 40, 9000):
        text = prose(rng, n)
        t = m.parse(m.fingerprint(text))
        assert t == m.tree(text) and m.grown(t.levels[0]).root == t.root and t.root.hex() == m.fingerprint(text)[:32]
        assert all(sum(weights) == len(below[0]) for (_, weights), below in zip(t.levels[1:], t.levels, strict=False))
        for i in range(0, len(t.levels[0][0]), 97):
            digests, weights = (list(x) for x in t.levels[0])
            digests[i] = hashlib.sha256(b"other").digest()[:16]
            assert m.grown((digests, weights)).root != t.root
    assert len(t.levels) > 3
    assert max(m.tree("same line of words\n" * 5000).levels[1][1]) <= m.MOST_CHILDREN


def test_small_and_repeated(spark):
    for data in ([], [(3, "one row only")], [(3, "same")] * 6 + [(4, None)] * 3):
        docs = spark.createDataFrame(data, "doc_id long, text string")
        assert sorted(map(tuple, m.fingerprints(docs).collect()), key=str) == want(data)


def test_texts_without_varied_words_keep_the_half_that_stays():
    rng = random.Random(9)
    signs = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(5000))
    few = " ".join(rng.choice(("alpha", "beta")) for _ in range(2000))
    for text in (signs, signs * 40, few, few.replace(" ", ""), "x" * 20_000, signs[:400], prose(rng, 100)):
        leaves = m.paragraphs(text)
        assert "".join(leaves) == text and max(map(len, leaves)) <= m.CUTS[-1].most
        other = "".join(chr(0x3041 + rng.randrange(80)) for _ in range(len(text)))
        assert m.likeness(m.tree(text), m.tree(m.edit(text, other))) > 0.35
    inserted = signs[:2000] + "?" + signs[2000:]
    assert m.likeness(m.tree(signs), m.tree(inserted)) > 0.9


def test_fingerprints_are_small_and_halves_that_stay_count():
    rng = random.Random(11)
    sizes = []
    for n in (500, 520, 700, 770, 1800, 3600, 7200, 40_000):
        for text in (prose(rng, n)[:n], "".join(chr(97 + rng.randrange(26)) for _ in range(n)), "y" * n):
            other = "".join(chr(0x3041 + rng.randrange(80)) for _ in range(n))
            assert m.likeness(m.tree(text), m.tree(m.edit(text, other))) > 0.33
            sizes.append((n, len(m.fingerprint(text))))
    assert all(size < n for n, size in sizes) and all(size < 0.1 * n for n, size in sizes if n == 40_000)
    try:
        m.parse("00" * 16 + "|" + m.fingerprint("some text").partition("|")[2])
        raise AssertionError("a wrong root was taken")
    except ValueError:
        pass
