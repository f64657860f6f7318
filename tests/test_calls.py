"""Names through imports and the nearest symbol, against brute force and in rows that meet."""

import random

from graphloom.operators import calls


def most_joined(df):
    """The most rows that a join of the plan gives."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        plan, most = [again._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            plan += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
        return most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_names_do_not_meet_imports_one_by_one(spark):
    rng = random.Random(3)
    files, names = [f"f{i}.py" for i in range(40)], [f"n{i}" for i in range(300)]
    symbols = [(f"s:{f}#{n}~{i}", f, n, i) for f in files for i, n in enumerate(rng.choices(names, k=6))]
    refs = [(f"f:{f}", f, n, i) for f in files for i, n in enumerate(rng.sample(names, 120))]
    imports = [(f, d) for f in files for d in rng.sample(files, 20) if d != f]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked, deps = table(refs, "sym string, path string, name string, line int"), table(imports, "path string, dep string")
    seen = calls.through_imports(asked, table(symbols, "id string, path string, name string, line int"), deps)
    want = {}
    for _, path, name, _ in refs:
        hit = [s[0] for d in {d for p, d in imports if p == path} for s in symbols if s[1:3] == (d, name)]
        if hit:
            want[path, name] = (1, hit[0]) if len(hit) == 1 else (2, None)
    got = {(r.path, r.name): (r.n_seen, r.d_seen if r.n_seen == 1 else None) for r in seen.collect()}
    assert got == want and {n for n, _ in want.values()} == {1, 2}
    whole = calls.resolve(asked, table(symbols, "id string, path string, name string, line int"), deps)
    assert whole.count() == len(refs)
    assert most_joined(whole) <= 2 * len(refs)


def test_the_nearest_symbol_takes_no_product_of_lines_and_symbols(spark):
    rng = random.Random(5)
    symbols = [("a", "x", rng.randrange(4000), rng.randrange(10**6)) for _ in range(600)] + [("a", "y", 5, 9), ("a", "y", 5, 3), ("a", "y", 9, 1), ("b", "x", 1, 8), ("c", "x", None, 4), ("c", "x", 70, 6), ("d", "x", None, 5), ("d", "x", None, 2)]
    at = [("a", rng.randrange(-50, 4100), "x") for _ in range(500)] + [("a", 7, "y"), ("a", 0, "y"), ("a", 5, "y"), ("a", None, "y"), ("b", 99, "x"), ("c", 3, "x"), ("d", 3, "x"), ("e", 1, "x"), (None, 1, "x"), ("a", 1, None)]
    high = 10**9
    want = {}
    for tp, tl, name in at:
        hit = [(high if line is None or tl is None else abs(line - tl), high if line is None else line, id_) for p, n, line, id_ in symbols if (p, n) == (tp, name)]
        if hit:
            want[tp, tl, name] = min(hit)[2]
    df = calls.nearest(spark.createDataFrame(at, "tp string, tl int, name string"), spark.createDataFrame(symbols, "path string, name string, line int, id long"))
    got = [((r.tp, r.tl, r.name), r.d_at) for r in df.collect()]
    assert dict(got) == want and len(got) == len(want)
    assert most_joined(df) <= len(at) + len(symbols)
