"""One source file to its facts: lines, symbols, imports and call sites.

Python files are read with the standard library's syntax tree, Java files with the Java compiler
where there is one; the other languages, and what does not parse, with the patterns of languages.py over text whose comments and
strings are blanked. Every function here is pure; parse() runs them in an Arrow stage.
"""

from __future__ import annotations

import ast
import gc
import hashlib
import re
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources import java_context, java_frontend
from graphloom.sources.languages import BRANCHES, BY_NAME, DECLARATION_KEYWORD, DECLARATION_SHAPE, DOC_MARKERS, NOT_DECLARED, NOT_NAMES, STATEMENT_STARTERS, STOPWORDS, TYPE_HINTS, Language

MAX_JOINED = 8
_CALL = re.compile(r"(?P<recv>[A-Za-z_$][\w$]*\s*(?:\.|->|::)\s*|\)\s*(?:\.|->|::)\s*)?(?P<name>[A-Za-z_$][\w$]*[!?]?)\s*\(")
_SHAPE, _KEYWORD = re.compile(DECLARATION_SHAPE), re.compile(DECLARATION_KEYWORD)

FACTS = """path string, lang string, kind string, loc int, code_lines int, comment_lines int, blank_lines int,
complexity int, max_nesting int, has_types boolean, hash string, unparsed int, frontend string, imports array<string>,
symbols array<struct<name:string,kind:string,line:int,length:int,complexity:int,documented:boolean,parent:string,body:string>>,
refs array<struct<owner:int,name:string,is_method:boolean,recv:string,line:int,cands:array<struct<mod:string,cls:string,name:string>>,tag:string,tpath:string,tline:int>>""".replace("\n", " ")


def blank_noise(text: str, lang: Language, strings: bool = True) -> str:
    """The text with comments, and strings if asked, replaced by spaces; lines and columns stay."""
    quotes = ['"', "`"] if lang.name in ("javascript", "typescript", "go") else ['"']
    quotes += ["'"] if lang.chars else []
    triples = ['"""', "'''"] if lang.triple and lang.name == "python" else ['"""'] if lang.triple else []
    block = [re.escape(lang.block[0]) + r"[\s\S]*?(?:" + re.escape(lang.block[1]) + r"|\Z)"] if lang.block else []
    line = [r"(?:" + "|".join(re.escape(c) for c in lang.line_comments) + r")[^\n]*"]
    long = [re.escape(t) + r"[\s\S]*?(?:" + re.escape(t) + r"|\Z)" for t in triples]
    short = [rf"{q}(?:\\.|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)" if q != "`" else r"`(?:\\.|[^`\\])*(?:`|\Z)" for q in quotes]
    comment = "|".join(f"(?:{p})" for p in ([*block, *line] if lang.name != "lua" else [*block, *line]))
    literal = "|".join(f"(?:{p})" for p in [*long, *short])
    spaces = lambda s: re.sub(r"[^\n]", " ", s)

    def swap(m: re.Match) -> str:
        if m.lastgroup == "c" or strings:
            return spaces(m[0])
        return m[0]

    return re.sub(rf"(?P<s>{literal})|(?P<c>{comment})", swap, text)


_CLOSED, _GOES_ON = re.compile(r"[{};]\s*$"), re.compile(r"\s*(?:throws\b|implements\b|extends\b|\{)")


def joined_lines(lines: list[str]) -> tuple[list[str], set[int]]:
    """Each line with those that close its parameter list and end its signature, up to a few, and which lines those are.

    A line whose parenthesis does not close in time stays as it is.
    """
    out, folded = list(lines), set()
    open_ = [line.count("(") - line.count(")") for line in lines]
    for i, line in enumerate(lines):
        if i in folded or "(" not in line:
            continue
        last, end, depth = min(len(lines), i + 1 + MAX_JOINED), i + 1, open_[i]
        while end < last and depth > 0:
            depth += open_[end]
            end += 1
        if depth > 0:
            continue
        while end < last and not _CLOSED.search(lines[end - 1]) and _GOES_ON.match(lines[end]):
            end += 1
        out[i] = " ".join([line, *(x.strip() for x in lines[i + 1 : end])])
        folded.update(range(i + 1, end))
    return out, folded


def indent(line: str) -> int:
    return len(line[: len(line) - len(line.lstrip(" \t"))].replace("\t", "    "))


def _name(m: re.Match) -> str | None:
    return next((m[g] for g in ("name", "bare") if g in m.re.groupindex and m[g]), None)


def _compiled(lang: Language) -> dict[str, list[re.Pattern]]:
    if not lang.compiled:
        lang.compiled.update({k: [re.compile(p) for p in getattr(lang, k)] for k in ("functions", "types", "imports")})
    return lang.compiled


def _documented(raw: list[str], at: int, lang: Language) -> bool:
    """Whether documentation stands within two lines below a declaration or in the line above it."""
    before = raw[at - 1].strip() if at else ""
    marker = DOC_MARKERS.get(lang.name)
    beside = [*raw[at + 1 : at + 3], before] if marker else []
    return any(re.search(marker, line.strip()) for line in beside) or before.startswith(lang.line_comments)


def _span(raw: list[str], at: int) -> int:
    """How many lines a declaration covers: while lines are blank or deeper than its own."""
    base, last = indent(raw[at]), at
    for j in range(at + 1, len(raw)):
        if raw[j].strip():
            if indent(raw[j]) <= base:
                break
            last = j
    return last - at + 1


def _declares(line: str) -> bool:
    """Whether a logical line may declare something: it does not begin as a statement."""
    lead = line.strip().split("(")[0].split()
    # a case class declares, whatever a case does elsewhere
    return not lead or lead[0] not in STATEMENT_STARTERS or lead[:2] in (["case", "class"], ["case", "object"])


def regex_symbols(raw: list[str], clean: list[str], lang: Language) -> list[dict]:
    """Types first, then functions; at most one symbol a line.

    The complexity of a symbol counts the branches of all lines up to the next symbol.
    """
    patterns, out = _compiled(lang), []
    joined, folded = joined_lines(clean)
    for at, line in enumerate(joined):
        if at in folded or not clean[at].strip() or not _declares(line):
            continue
        name, kind = next((n for p in patterns["types"] if (m := p.match(line)) and (n := _name(m))), None), "Class"
        if name is None:
            named = (n for p in patterns["functions"] if (m := p.match(line) or p.search(line)) and (n := _name(m)))
            name, kind = next((n for n in named if n not in NOT_NAMES), None), "Function"
        if name is not None:
            length = _span(raw, at)
            out.append({"name": name, "kind": kind, "line": at + 1, "length": length, "complexity": 1, "documented": _documented(raw, at, lang), "parent": None, "body": "\n".join(clean[at : at + length])})
    for i, s in enumerate(out):
        end = out[i + 1]["line"] - 1 if i + 1 < len(out) else len(raw)
        s["complexity"] += len(BRANCHES.findall("\n".join(raw[s["line"] - 1 : max(end, s["line"])])))
        around = [t for t in out[:i] if t["kind"] == "Class" and t["line"] < s["line"] < t["line"] + t["length"]]
        s["parent"] = around[-1]["name"] if around else None
    return out


def unparsed(clean: list[str], starts: set[int]) -> int:
    """Lines shaped like a declaration at which no symbol was found."""
    missed, folded = 0, joined_lines(clean)[1]
    for i, line in enumerate(clean):
        text = line.strip()
        lead = text.split("(")[0].split()
        if i in folded or i + 1 in starts or not text or text.startswith(("}", ")", "]", "*", "@", ".", "//")) or (lead and lead[0] in NOT_DECLARED):
            continue
        shaped = _SHAPE.match(line)
        missed += shaped[1] not in NOT_DECLARED if shaped else bool(_KEYWORD.match(line))
    return missed


def regex_imports(kept: list[str], lang: Language) -> list[str]:
    found: dict[str, None] = {}
    for line in kept:
        for pattern in _compiled(lang)["imports"]:
            for m in pattern.finditer(line):
                if name := _name(m):
                    found.setdefault(name)
    return list(found)


def _ref(owner: int, name: str, recv: str | None, line: int, cands: list | None = None) -> dict:
    return {"owner": owner, "name": name, "is_method": recv is not None, "recv": recv, "line": line, "cands": cands or [], "tag": None, "tpath": None, "tline": None}


def regex_refs(clean: list[str], symbols: list[dict]) -> list[dict]:
    """All call sites inside functions, after the declaration."""
    out = []
    for owner, s in enumerate(symbols):
        if s["kind"] != "Function":
            continue
        for at in range(s["line"], s["line"] + s["length"] - 1):
            for m in _CALL.finditer(clean[at]):
                name, recv = m["name"], m["recv"]
                if len(name) < 2 or name == s["name"] or name in STOPWORDS:
                    continue
                if recv is not None:
                    recv = re.sub(r"[^\w$]", "", recv)
                out.append(_ref(owner, name, recv, at + 1))
    return out


#: Where statements hold others, in the order of their fields, and expressions that hold no call.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Pass))
_PLAIN = frozenset((ast.Expr, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Pass, ast.Raise, ast.Assert, ast.Delete, ast.Global, ast.Nonlocal, ast.Break, ast.Continue))


def _statements(node: ast.AST) -> Iterator[ast.AST]:
    """A statement and all below it in the order of ast.walk(), without the expressions between them."""
    level = [node]
    while level:
        yield from level
        level = [below for above in level if type(above) not in _PLAIN for block in _BLOCKS for below in getattr(above, block, ())]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Python's search for cycles, of which syntax trees have none, waits until what runs inside is done."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class _Scope:
    """Symbols and calls of a Python module, with what imports, types and assignments bind."""

    def __init__(self, text: str, clean: list[str]) -> None:
        self.text, self.clean = text.splitlines(), clean
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.imports: dict[str, None] = {}
        self.alias: dict[str, tuple[str, str]] = {}  # name -> (module, name in it or "")
        self.bases: dict[str, list[str]] = {}
        self.fields: dict[str, dict[str, str]] = {}
        self.owner, self.cls, self.types = -1, [], [{}]

    def module(self, tree: ast.Module) -> None:
        for node in _statements(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.imports.setdefault(a.name)
                    self.alias[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], "")
            elif isinstance(node, ast.ImportFrom):
                source = "." * node.level + (node.module or "")
                self.imports.setdefault(source)
                for a in node.names:
                    self.alias[a.asname or a.name] = (source, a.name)
            elif isinstance(node, ast.ClassDef):
                self.bases[node.name] = [b for b in map(self._plain, node.bases) if b]
                own = self.fields.setdefault(node.name, {})
                for x in _statements(node):
                    if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (made := self._plain(x.value.func)):
                        for t in x.targets:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                own[t.attr] = made
        self.visit(tree)

    @staticmethod
    def _plain(node: ast.AST | None) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
            return node.value
        if isinstance(node, ast.Subscript):
            return _Scope._plain(node.slice) if _Scope._plain(node.value) == "Optional" else None
        return None

    def _symbol(self, node, kind: str) -> int:
        first = node.lineno
        length = (node.end_lineno or first) - first + 1
        body = "\n".join(self.clean[first - 1 : first - 1 + length])
        self.symbols.append({"name": node.name, "kind": kind, "line": first, "length": length, "complexity": 1 + len(BRANCHES.findall("\n".join(self.clean[first : first - 1 + length]))), "documented": ast.get_docstring(node, clean=False) is not None, "parent": self.cls[-1] if self.cls else None, "body": body})
        return len(self.symbols) - 1

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in node.decorator_list + node.bases:
            self.visit(d)
        outer, self.owner = self.owner, self._symbol(node, "Class")
        self.cls.append(node.name)
        for child in node.body:
            self.visit(child)
        self.cls.pop()
        self.owner = outer

    def _function(self, node) -> None:
        for d in node.decorator_list:
            if not isinstance(d, ast.Call) and (name := d.attr if isinstance(d, ast.Attribute) else self._plain(d)):
                self._call(d, name, d.lineno)
            self.visit(d)
        outer, self.owner = self.owner, self._symbol(node, "Function")
        known = {}
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if kind := self._plain(a.annotation):
                known[a.arg] = kind
        for x in _statements(node):
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (made := self._plain(x.value.func)) and made[:1].isupper():
                known.update({t.id: made for t in x.targets if isinstance(t, ast.Name)})
        self.types.append(known)
        classes, self.inside = self.cls, self.cls[-1] if self.cls else getattr(self, "inside", None)
        self.cls = []
        for child in node.body:
            self.visit(child)
        self.cls = classes
        self.types.pop()
        self.owner = outer

    def _class(self, name: str, member: str, depth: int = 0) -> list[tuple[str, str, str]]:
        """Where a member of a class could be defined: the class, then its bases."""
        mod, real = self.alias.get(name, ("", name))
        out = [(mod, real or name, member)]
        if depth < 4:
            for base in self.bases.get(name, []):
                out += self._class(base, member, depth + 1)
        return out

    def _candidates(self, func: ast.AST, name: str) -> list[tuple[str, str, str]]:
        if isinstance(func, ast.Name):
            if name in self.alias:
                mod, real = self.alias[name]
                return [(mod, "", real)] if real else []
            return []
        if not isinstance(func, ast.Attribute):
            return []
        on = func.value
        inside = self.cls[-1] if self.cls else getattr(self, "inside", None)
        if isinstance(on, ast.Name):
            if on.id in ("self", "cls") and inside:
                return self._class(inside, name)
            for known in reversed(self.types):
                if on.id in known:
                    return self._class(known[on.id], name)
            if on.id in self.alias:
                mod, real = self.alias[on.id]
                return [(mod, "", name)] if not real else [(mod, real, name), (f"{mod}.{real}" if not mod.endswith(".") else mod + real, "", name)]
            if on.id in self.bases:
                return self._class(on.id, name)
        if isinstance(on, ast.Attribute) and isinstance(on.value, ast.Name) and on.value.id == "self" and inside and (kind := self.fields.get(inside, {}).get(on.attr)):
            return self._class(kind, name)
        if isinstance(on, ast.Call) and self._plain(on.func) == "super" and inside:
            return [c for base in self.bases.get(inside, []) for c in self._class(base, name)]
        if isinstance(on, ast.Call) and (made := self._plain(on.func)) and made[:1].isupper():
            return self._class(made, name)
        return []

    def _call(self, func: ast.AST, name: str, line: int) -> None:
        cands = self._candidates(func, name)
        own = self.symbols[self.owner]["name"] if self.owner >= 0 else None
        if not cands and (name in STOPWORDS or name == own or len(name) < 2):
            return
        recv = None
        if isinstance(func, ast.Attribute):
            recv = func.value.id if isinstance(func.value, ast.Name) else ""
        self.refs.append(_ref(self.owner, name, recv, line, [{"mod": m, "cls": c, "name": n} for m, c, n in cands]))

    def visit(self, node: ast.AST) -> None:
        (self._OWN.get(type(node)) or _Scope.generic_visit)(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for name in node._fields:
            below = getattr(node, name, None)
            for x in below if type(below) is list else (below,):
                if isinstance(x, ast.AST) and type(x) not in _LEAVES:
                    self.visit(x)

    def visit_Call(self, node: ast.Call) -> None:
        func = node.func
        if name := func.attr if isinstance(func, ast.Attribute) else self._plain(func) if isinstance(func, ast.Name) else None:
            self._call(func, name, func.end_lineno if isinstance(func, ast.Attribute) else node.lineno)
        self.generic_visit(node)

    _OWN = {ast.ClassDef: visit_ClassDef, ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.Call: visit_Call}


FRONTENDS = ("python", "java")


def _chosen(frontends: bool | tuple[str, ...]) -> tuple[str, ...]:
    return FRONTENDS if frontends is True else tuple(frontends or ())


def compiled_java(read: dict, clean: list[str]) -> dict:
    """Symbols, calls and imports as the compiler has read them, in the order of their lines."""
    order = sorted(range(len(read["symbols"])), key=lambda i: read["symbols"][i]["line"])
    place = {old: new for new, old in enumerate(order)}
    symbols = []
    for i in order:
        s = read["symbols"][i]
        at = s["line"] - 1
        body = clean[at : at + s["length"]]
        symbols.append(s | {"complexity": 1 + len(BRANCHES.findall("\n".join(body))), "body": "\n".join(body)})
    refs = []
    for c in read["calls"]:
        owner = place.get(c["owner"], -1)
        own = symbols[owner]["name"] if owner >= 0 else None
        # what the compiler has bound counts whatever its name
        if c["tag"] is None and (len(c["name"]) < 2 or c["name"] == own or c["name"] in STOPWORDS):
            continue
        refs.append(c | {"owner": owner})
    return {"frontend": "javac", "symbols": symbols, "refs": refs, "imports": list(dict.fromkeys(read["imports"])), "unparsed": 0}


def facts(path: str, lang: str, kind: str, content: bytes, frontends: bool | tuple[str, ...] = True, java: dict | None = None) -> dict:
    """All facts of one file; anything a syntax tree cannot read falls back to patterns.

    frontends: the languages whose own reader is used; java: what the Java compiler has read.
    """
    text = content.decode("utf-8", "ignore")
    raw = text.splitlines()
    out = {"path": path, "lang": lang, "kind": kind, "loc": len(raw), "code_lines": 0, "comment_lines": 0, "blank_lines": sum(not x.strip() for x in raw), "complexity": 0, "max_nesting": 0, "has_types": False, "hash": hashlib.sha1(content).hexdigest(), "unparsed": 0, "frontend": "regex", "imports": [], "symbols": [], "refs": []}
    language = BY_NAME.get(lang)
    if language is None:
        return out | {"code_lines": out["loc"] - out["blank_lines"]}
    clean = blank_noise(text, language).splitlines()
    clean += [""] * (len(raw) - len(clean))
    code = [c for c, r in zip(clean, raw, strict=False) if r.strip() and c.strip()]
    out |= {
        "code_lines": len(code),
        "comment_lines": out["loc"] - out["blank_lines"] - len(code),
        "complexity": len(BRANCHES.findall("\n".join(clean))),
        "max_nesting": max((indent(c) // 4 for c in code), default=0),
        "has_types": lang in TYPE_HINTS and any(re.search(TYPE_HINTS[lang], c) for c in code),
    }
    if lang == "java" and java is not None:
        return out | compiled_java(java, clean)
    if lang == "python" and "python" in _chosen(frontends):
        try:
            with warnings.catch_warnings(), _uncollected():
                warnings.simplefilter("ignore")
                scope = _Scope(text, clean)
                scope.module(ast.parse(text))
            return out | {"frontend": "ast", "imports": list(scope.imports), "symbols": scope.symbols, "refs": scope.refs}
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    symbols = regex_symbols(raw, clean, language)
    commentless = blank_noise(text, language, strings=False).splitlines()
    return out | {"imports": regex_imports(commentless, language), "symbols": symbols, "refs": regex_refs(clean, symbols), "unparsed": unparsed(clean, {s["line"] for s in symbols})}


def _without_noise(text: str) -> tuple[str, str]:
    """A Java text without comments, and without strings too."""
    return blank_noise(text, BY_NAME["java"], strings=False), blank_noise(text, BY_NAME["java"])


def java_surface(files: DataFrame) -> DataFrame:
    """What the Java files among files (path, lang, content) declare and mention."""
    return java_context.surface(files.filter("lang = 'java'"), _without_noise)


def java_batches(java: DataFrame) -> tuple[int, DataFrame]:
    """How many batches the compiler reads, and the Java files with theirs; a file of many bytes is one of its own."""
    size = F.octet_length("content")
    lone = size > java_frontend.BATCH_BYTES // 4
    row = java.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~lone, size)), F.lit(0)).alias("bytes"), F.count_if(lone).alias("lone")).first()
    shared = max(1, -(-(row["n"] - row["lone"]) // java_frontend.BATCH_FILES), -(-row["bytes"] // java_frontend.BATCH_BYTES))
    # files of one folder go together, so most of what a batch calls is in it
    folder = F.pmod(F.xxhash64(F.substring_index("path", "/", 4)), F.lit(shared))
    batches = row["lone"] + (shared if row["n"] > row["lone"] else 0)
    return max(1, batches), java.withColumn("batch", F.when(lone, shared + F.pmod(F.xxhash64("path"), F.lit(1 << 40))).otherwise(folder))


#: Bytes of text whose facts are held at once; a longer file is read alone.
PORTION_BYTES = 1 << 20


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of files in portions of few bytes, whatever the session lets an Arrow batch hold."""
    first = held = 0
    for i, size in enumerate(pc.binary_length(batch["content"]).to_pylist()):
        if i > first and held + (size or 0) > PORTION_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def parse(files: DataFrame, frontends: bool | tuple[str, ...] = True, root: str | None = None, surfaces: DataFrame | None = None) -> DataFrame:
    """One row of facts for each file (path, lang, kind, content).

    root: the folder of the tree, for Java's source roots; surfaces: java_surface() of a whole
    tree of which the files are a part. Java files in several batches see each other's headers.
    """
    schema = files.sparkSession.createDataFrame([], FACTS).toArrow().schema
    columns = ("path", "lang", "kind", "content")
    files = files.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in _portions(batch):
                yield pa.RecordBatch.from_pylist([facts(*(r[c] for c in columns), frontends) for r in few.to_pylist()], schema=schema)

    if "java" not in _chosen(frontends):
        return files.mapInArrow(run, FACTS)

    def compiled(group: pa.Table, around: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        texts = [(r["path"], r["content"].decode("utf-8", "ignore")) for r in rows]
        roots = sorted({found for p, t in texts if (found := java_frontend.source_root(p, t)) is not None}) if root else []
        beside = [(r["path"], r["header"]) for r in around.select(["path", "header"]).to_pylist()]
        read = java_frontend.read(texts, [f"{root}/{r}".rstrip("/") for r in roots], beside)
        return pa.Table.from_pylist([facts(*(r[c] for c in columns), frontends, read.get(r["path"])) for r in rows], schema=schema)

    java = files.filter("lang = 'java'")
    batches, dealt = java_batches(java)
    others = files.filter("lang is null or lang <> 'java'").mapInArrow(run, FACTS)
    if batches == 1 and surfaces is None:
        nothing = pa.table({"path": pa.array([], pa.string()), "header": pa.array([], pa.string())})
        return others.unionByName(dealt.groupBy("batch").applyInArrow(lambda group: compiled(group, nothing), FACTS))
    headers = java_context.needed(surfaces if surfaces is not None else java_surface(java), dealt.select("path", "batch"))
    return others.unionByName(dealt.groupBy("batch").cogroup(headers.groupBy("batch")).applyInArrow(compiled, FACTS))
