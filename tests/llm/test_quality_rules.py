import random
import re

import numpy as np

from graphloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w in windows if windows.count(w) > 1}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ".\n"]) for _ in range(n))


def table(n=400, seed=5):
    rng = random.Random(seed)
    data = [(i, prose(rng, rng.randrange(50, 200)), rng.choice(["en", None]), rng.choice(["a", "b"]), "x") for i in range(n)]
    odd = [prose(rng, 120).replace(" ", "%%%$$ "), prose(rng, 120).upper(), "x | " * 100, "a b c " * 60, "line\n" * 80, None, "", " \n ", "été ça"]
    odd += [" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(k)) for k in (3, 4, 5, 60, 90, 200)]
    return data + [(1000 + i, t, "en", "a", "x") for i, t in enumerate(odd)] + data[:2] * 3


def mcd(x, starts=60, seed=1):
    """log determinant, centre and covariance of the best of many random starts, in numpy."""
    rng, best = np.random.default_rng(seed), None
    floor = np.diag([q.FLOORS[v] ** 2 for v in q.VECTOR])
    for _ in range(starts):
        near = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(40):
            m, c = near.mean(0), 1.412 * np.cov(near.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(len(x) * 0.75))]]
        level = np.linalg.slogdet(c)[1]
        if best is None or level < best[0]:
            best = (level, m, c)
    return best


def vector(text):
    words, chars, symbols, doubled, covered = counts(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    upper = sum(c.isupper() for c in text)
    return [np.log(max(chars, 1) / max(words, 1)), *np.sqrt([symbols / max(chars, 1), doubled / max(len(lines), 1), covered / max(words, 1), upper / max(chars, 1)])]


def test_verdicts_equal_brute_force(spark):
    data = [(*r[:2], "en", "a", r[4]) for r in table(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, d2 string")
    rows = sorted(((r.doc_id, r.base_failed, r.kept, r.d2) for r in q.judge(docs, "doc_id").collect()), key=str)
    good = [t for _, t, *_ in data if (c := counts(t))[0] >= 50 and 2 * c[4] <= c[0]]
    _, m, c = mcd(np.array([vector(t) for t in good]))
    for (doc_id, failed, kept, d2), (_, text) in zip(rows, sorted(((i, t) for i, t, *_ in data), key=str), strict=True):
        if not failed:
            off = np.array(vector(text)) - m
            want = off @ np.linalg.inv(c) @ off
            assert abs(d2 - want) < 0.1 * want + 0.1
            assert kept == (d2 <= q.CUTOFF)


def test_counts_equal_brute_force(spark):
    data = table()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words string")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.judge(docs, "doc_id").collect())
    want = []
    for doc_id, text, *_ in data:
        c = counts(text)
        want.append((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)


def test_clean_stays_and_junk_goes(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_words string")
    kept = {r.doc_id: r.kept for r in q.judge(docs, "doc_id", prior=50).collect()}
    assert all(kept[i] for i in range(400))
    assert not any(kept[1000 + i] for i in range(9))
    assert sorted(r.doc_id for r in q.keep_documents(docs, prior=50).collect() if r.doc_id < 400) == sorted([*range(400), 0, 1] + [0, 1] * 2)


def test_concentration_steps_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(q.VECTOR))) * 0.2 + 1
    x[:60] += 8
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["group", *q.VECTOR])
    found = q.estimates(rows).first()
    _, m, c = mcd(x)
    assert np.allclose([found[f"m_{v}"] for v in q.VECTOR], m, atol=0.01)
    factor = np.array([[found[f"l_{a}_{b}"] if j <= i else 0 for j, b in enumerate(q.VECTOR)] for i, a in enumerate(q.VECTOR)])
    assert np.allclose(factor @ factor.T, c, atol=0.005) and abs(found["logdet"] - np.linalg.slogdet(c)[1]) < 0.05


def test_stage_keeps_columns_of_any_name_and_long_texts(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, 80), "en", "a", i, "t", False) for i in range(40)] + [(100, prose(rng, 60_000), "en", "a", 0, "u", True), (100, prose(rng, 60_000), None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, _tag int, `group` string, kept boolean")
    kept = q.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.judge(docs, "doc_id").collect() == []


def test_small_groups_lean_on_what_is_around_them(spark):
    rng = random.Random(8)
    data = [(i, prose(rng, 120), "en", "big" if i < 300 else f"s{i % 40}" if i < 380 else "one" if i == 380 else "big") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    alone = {r.doc_id: r for r in q.judge(docs, "doc_id").collect()}
    assert all(r.kept for r in alone.values())
    # beside its language of rows like its own, a row is as far off in a small group as in a large one
    whole = {r.doc_id: r.d2 for r in q.judge(docs.drop("source").selectExpr("*", "'big' as source"), "doc_id").collect()}
    assert all(alone[i].d2 <= whole[i] * 1.5 + 1 for i in range(300, 381))
    # rows that come to another source of another language change little for these
    more = [(1000 + i, prose(rng, 120), "de", "new") for i in range(500)]
    got = {r.doc_id: r.d2 for r in q.judge(spark.createDataFrame(data + more, docs.schema), "doc_id").collect()}
    assert all(abs(got[i] - alone[i].d2) < 0.25 * alone[i].d2 + 0.5 for i in range(400))
