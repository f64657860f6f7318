"""Java calls are bound alike whatever the batches, and after edits as by a whole reading."""

import pytest

from graphloom.sources import index as ix
from graphloom.sources import java_context, java_frontend
from graphloom.sources.languages import BY_NAME
from graphloom.sources.parse import blank_noise, java_batches, parse

CODE = """package p.q;

import static p.r.Tool.*;
import p.s.Outer.Inner;

@Marked(names = {"{", "}"}, of = Kind.class)
public class Kind<T extends Base<T>> extends Base<T> implements Runnable {
    static { start(1); }
    private final int[] sizes = {1, 2};
    private final Runnable later = () -> { run(); };
    private final Base<T> odd = new Base<>() { void hook() { run(); } };

    @Given(at = max(1, 2))
    public Kind(int a) throws java.io.IOException,
            Lost {
        // a { brace
        call("}");
    }

    enum Side { LEFT { int of() { return 1; } }, RIGHT; int of() { return 2; } }

    interface Part { default void go() { if (x) { y(); } } }

    abstract Part part();

    public void run() {
        part().go();
    }
}
"""


def blanked(text, strings=True):
    return blank_noise(text, BY_NAME["java"], strings)


def test_headers_keep_declarations_and_lines():
    short = java_context.header(blanked(CODE, False), blanked(CODE))
    assert short.count("\n") == CODE.count("\n")
    assert "part().go()" not in short and "call(" not in short and "y()" not in short and "return 2" not in short
    for line, text in ((14, "public Kind(int a) throws"), (20, "enum Side"), (22, "default void go() {}"), (24, "abstract Part part();"), (26, "public void run() {")):
        assert text in short.split("\n")[line - 1]
    assert "sizes = {1, 2}" in short
    # a file cut short, and one with nothing in it, have headers as well
    assert java_context.header("class A { void f() { x", "class A { void f() { x") == "class A { void f() {"
    assert java_context.header("", "") == ""


def test_mentions_name_own_imported_and_full_types():
    row = java_context.surface_of("x/Kind.java", blanked(CODE, False), blanked(CODE))
    uses, short = ({(u["package"], u["name"]) for u in row[c]} for c in ("uses", "header_uses"))
    assert row["package"] == "p.q" and {"Kind", "Side", "Part"} <= set(row["types"])
    assert {("p.q", "Base"), ("p.r.Tool", "Base"), ("p.s", "Outer"), ("p.s.Outer", "Inner"), ("java.io", "IOException")} <= uses
    assert ("p.q", "y") in uses and ("p.q", "y") not in short and ("p.q", "Base") in short


def ring(n):
    """Classes in folders of their own, each calling the next through what the one after that inherits."""
    tree = {}
    for i in range(n):
        a, b = (i + 1) % n, (i + 2) % n
        tree[f"d{i}/e/f/g{i}/C{i}.java"] = f"package g{i};\n\nimport g{a}.C{a};\n\npublic class C{i} extends gb{i}.Base {{\n    public g{b}.C{b} far(C{a} x) {{\n        x.near();\n        return x.far(null).mine();\n    }}\n\n    public C{i} mine() {{\n        return this;\n    }}\n}}\n"
        tree[f"h{i}/e/f/gb{i}/Base.java"] = f"package gb{i};\n\npublic class Base {{\n    public void near() {{\n        String.valueOf({i});\n    }}\n}}\n"
    return tree


def rows_of(spark, tree):
    return spark.createDataFrame([(p, "java", "code", bytearray(t.encode())) for p, t in tree.items()], "path string, lang string, kind string, content binary")


def told(facts):
    """What was read of every file, calls with the places to which the compiler has bound them."""
    return {r.path: r.asDict(recursive=True) for r in facts.collect()}


@pytest.fixture
def compiler():
    if not java_frontend.available():
        pytest.skip("no Java compiler")


def test_batches_of_any_size_find_the_same_calls(spark, compiler, monkeypatch):
    files = rows_of(spark, ring(6))
    whole = told(parse(files))
    tags = [c["tag"] for f in whole.values() for c in f["refs"]]
    # near, far and mine of every class, all bound by the compiler; only String lies outside
    assert tags.count("at") == 18 and tags.count("ext") == 6 and len(tags) == 24
    for size in (1, 2, 5):
        monkeypatch.setattr(java_frontend, "BATCH_FILES", size)
        assert told(parse(files)) == whole


def test_an_edit_reads_dependents_again_and_others_not(spark, compiler, tmp_path, monkeypatch):
    def put(tree):
        for name, text in tree.items():
            at = tmp_path / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)

    chain = {f"c{i}/K{i}.java": f"package c{i};\n\npublic class K{i} {{\n    public int go() {{\n        return {f'new c{i + 1}.K{i + 1}().go()' if i < 4 else '1'};\n    }}\n}}\n" for i in range(5)}
    put(chain)
    monkeypatch.setattr(ix, "build", lambda facts: None)
    facts = ix.index(spark, str(tmp_path))[1]
    read_again = []
    plain = ix.parse

    def watched(files, *rest):
        read_again.append({r.path for r in files.select("path").collect()})
        return plain(files, *rest)

    monkeypatch.setattr(ix, "parse", watched)

    def after_edit(cached):
        fresh = ix.index(spark, str(tmp_path), cached=cached)[1]
        again = read_again[-1]
        assert told(fresh) == told(plain(ix.discover(spark, str(tmp_path)), True, str(tmp_path)))
        return fresh, again

    # a caller changes and calls what was left alone; a callee's lines move, and another method of its name takes its old line
    put({
        "c1/K1.java": "package c1;\n\npublic class K1 {\n    public int go() {\n        return new c2.K2().go();\n    }\n\n    int more() {\n        return new c3.K3().go();\n    }\n}\n",
        "c4/K4.java": "package c4;\n\npublic class K4 {\n    int go(int x) {\n        return x;\n    }\n\n\n\n    public int go() {\n        return 1;\n    }\n}\n",
    })
    facts, again = after_edit(facts)
    assert again == {"c0/K0.java", "c1/K1.java", "c3/K3.java", "c4/K4.java"}
    assert {c["tag"] for c in told(facts)["c1/K1.java"]["refs"]} == {"at"}
    # a file goes, and a new one elsewhere declares its type
    (tmp_path / "c2/K2.java").unlink()
    put({"z/New.java": "package c2;\n\n\npublic class K2 {\n\n    public int go() {\n        return new c0.K0().go();\n    }\n}\n"})
    _, again = after_edit(facts)
    assert again == {"c1/K1.java", "z/New.java"}


def test_batches_hold_so_many_bytes_and_long_files_are_read_alone(spark, compiler, monkeypatch):
    tree = ring(6)
    for i in (1, 4):
        path = f"h{i}/e/f/gb{i}/Base.java"
        tree[path] = tree[path].rstrip("}\n") + "}\n" + "    // long\n" * 300 + "}\n"
    files = rows_of(spark, tree)
    whole = told(parse(files))
    monkeypatch.setattr(java_frontend, "BATCH_BYTES", 4 * 1500)
    n, dealt = java_batches(files)
    of = {}
    for r in dealt.collect():
        of.setdefault(r.batch, []).append(len(r.content))
    long_ = sorted(len(t.encode()) for t in tree.values() if len(t) > 1500)
    assert len(long_) == 2 and sorted(s for sizes in of.values() for s in sizes if len(sizes) == 1 and s > 1500) == long_
    assert n == 2 + max(1, -(-sum(len(t.encode()) for t in tree.values() if len(t) <= 1500) // 6000)) and sum(map(len, of.values())) == len(tree)
    assert told(parse(files)) == whole
