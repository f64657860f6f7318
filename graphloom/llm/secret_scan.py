"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: the literal strings
a match must hold, one alternative for each way to match, each an AND of its trigrams. The
index has a posting (trigram, document) for the trigrams of any query; postings meet per
document and alternative, and a document is a candidate of a rule where an alternative has
all of its trigrams. Candidates alone are fetched and verified with the regular expression
itself, and only their spans travel back to the rows. A rule without mandatory trigrams scans
every text where it lies.

Trigrams are of lower-cased text, so the index never misses a match; documents are keyed by
id and text hash, so repeated rows share their postings and still get a row each. Null and
empty texts have no spans. Overlapping matches of two rules are two spans, and one mark in
mask_documents(). Extra columns, whatever their names, play no part and are kept by
mask_documents(). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import durable

#: Alternatives of one rule, and literal strings kept while deriving them.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind, a pattern, which group to measure, and the least length of that group."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: The base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
RULES = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", ACCESS, 0, 16),
    Rule("hex", HEX, 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35, base=False),
)


def _strings(parsed: list) -> list[list[str]] | None:
    """Each way to match as runs of adjacent literals; None stands between runs. None: too many."""
    ways: list[list] = [[]]
    for kind, arg in parsed:
        if kind is op.LITERAL:
            more = [[chr(arg)]]
        elif kind is op.IN and len(chars := _few(arg)) in range(1, 9):
            more = [[c] for c in chars]
        elif kind is op.SUBPATTERN:
            more = _strings(arg[3])
        elif kind is op.BRANCH:
            more = [way for branch in arg[1] for way in (_strings(branch) or [[None]])]
        elif kind is op.MAX_REPEAT and arg[:2] == (0, 1):
            more = [[], *(_strings(arg[2]) or [[None]])]
        elif kind is op.MAX_REPEAT and 1 <= arg[0] == arg[1] <= 8:
            more = [a * arg[0] for a in (_strings(arg[2]) or [[None]])]
        else:
            more = [[None]]
        if more is None or len(ways) * len(more) > MOST_STRINGS:
            more = [[None]]
        ways = [a + b for a, b in product(ways, more)]
    return ways


def _few(members: list) -> list[str]:
    """The characters of a class of single characters; none for a class with ranges."""
    return [chr(arg) for kind, arg in members] if all(kind is op.LITERAL for kind, _ in members) else []


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR over AND: the trigrams of each alternative; empty if some alternative has none."""
    found = set()
    for way in _strings(list(parser.parse(pattern))) or [[None]]:
        runs = "".join("\0" if c is None else c for c in way).lower().split("\0")
        found.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def plan(rules: tuple[Rule, ...]) -> tuple[list[str], list[tuple[int, frozenset[str]]]]:
    """The trigrams of the index; (rule, trigrams) of every alternative."""
    clauses = [(i, clause) for i, rule in enumerate(rules) for clause in trigram_query(rule.pattern)]
    return sorted({t for _, clause in clauses for t in clause}), clauses


KEY = ["key_id", "key_hash"]
NO_SPANS = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def _keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, the key of each document and its text."""
    return docs.select(*columns, F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_hash"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings: trigram (its number in plan()) and key of the document."""
    trigrams, _ = plan(rules)
    lowered = _keyed(docs).select(*KEY, F.lower("body").alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return lowered.select(F.explode(held).alias("trigram"), *KEY).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and mask: the bits of the rules that a document is a candidate of."""
    trigrams, clauses = plan(rules)
    uses = [[k for k, (_, clause) in enumerate(clauses) if t in clause] for t in trigrams]
    table = F.expr("array(" + ",".join("array(" + ",".join(map(str, u)) + ")" for u in uses) + ")")
    need = F.expr("array(" + ",".join(str(len(c)) for _, c in clauses) + ")")
    bit = F.expr("array(" + ",".join(str(1 << rule) for rule, _ in clauses) + ")")
    met = postings.select(*KEY, F.explode(F.element_at(table, F.col("trigram") + 1)).alias("clause")).groupBy(*KEY, "clause").agg(F.count(F.lit(1)).alias("n"))
    return met.filter(F.col("n") == F.element_at(need, F.col("clause") + 1)).groupBy(*KEY).agg(F.bit_or(F.element_at(bit, F.col("clause") + 1)).alias("mask"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """The sum of all elements before each, over blocks of about the root of the size."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def by(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")), lambda b: total(F.slice(lengths, b * width + 1, width)))
        before = let(blocks, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))
        block = lambda i: F.floor(i / width).cast("int")
        return let(before, lambda f: F.transform(lengths, lambda x, i: F.get(f, block(i)) + total(F.slice(lengths, block(i) * width + 1, i - block(i) * width))))

    return let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), by)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """start, rank and end of each match that is long enough, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("own"))

    def placed(f: Column) -> Column:
        matched, own = F.transform(f["all"], F.length), F.transform(f["own"], F.length)
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(f["all"])), F.length)
        cut = let(F.struct(matched.alias("m"), own.alias("o"), gaps.alias("g")), lambda s: let(sums_before(F.zip_with(s["g"], s["m"], lambda a, b: a + b)), lambda at: F.transform(at, lambda x, i: F.struct((x + F.get(s["g"], i)).alias("start"), F.lit(rank).alias("rank"), (x + F.get(s["g"], i) + F.get(s["m"], i)).alias("end"), F.get(s["o"], i).alias("own")))))
        long = F.filter(cut, lambda x: x["own"] >= rule.least)
        return F.when(F.size(f["all"]) == 0, F.expr(NO_SPANS)).otherwise(F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))

    return let(found, placed)


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left with the columns that right has for its key."""
    right = right.withColumnsRenamed({k: f"of_{k}" for k in KEY})
    return left.join(right, left["key_id"].eqNullSafe(right["of_key_id"]) & (left["key_hash"] == right["of_key_hash"]), how).drop(*(f"of_{k}" for k in KEY))


def verified(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Key and spans of the candidates that hold a match of a rule with mandatory trigrams."""
    found = durable(candidates(durable(index(docs, rules), "secret-postings"), rules), "secret-candidates")
    each = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, _spans(F.col("body"), rule, i)).otherwise(F.expr(NO_SPANS)) for i, rule in enumerate(rules) if trigram_query(rule.pattern)]
    held = _met(_keyed(docs), found, "inner").select(*KEY, F.flatten(F.array(*each)).alias("met"))
    return durable(held.filter(F.size("met") > 0).dropDuplicates(KEY), "secret-spans")


def scan(docs: DataFrame, *columns: str | Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns and spans: start, rank (of the rule) and end of all secrets of each document."""
    full = [_spans(F.col("body"), rule, i) for i, rule in enumerate(rules) if not trigram_query(rule.pattern)]
    names = docs.select(*columns).columns
    placed = _keyed(docs, *columns).select(*names, *KEY, F.flatten(F.array(F.expr(NO_SPANS), *full)).alias("full"))
    return _met(placed, verified(docs, rules), "left").select(*names, F.sort_array(F.concat("full", F.coalesce("met", F.expr(NO_SPANS)))).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans, per document."""
    found = scan(docs, "doc_id", rules=rules)
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rank"] == [r.kind for r in rules].index(kind))).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *[count(rules[i].kind) for i in base], F.sha2(_shown(own, rules), 256).alias("base_sha256"), _shown(F.col("spans"), rules).alias("spans"))


def mask_documents(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret replaced by a mark; overlapping spans become one."""
    found = scan(docs, F.struct("*").alias("row"), rules=rules)
    body = F.coalesce(F.col("row.text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<from:int,to:int>>)")
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to")))).otherwise(none)).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    start = F.struct(none.alias("out"), F.lit(0).alias("at"))
    text = let(F.aggregate("spans", start, step), lambda r: F.concat(F.array_join(F.transform(r["out"], lambda g: F.concat(F.substring(body, g["from"] + 1, g["to"] - g["from"]), F.lit(mark))), ""), F.substring(body, r["at"] + 1, F.length(body))))
    return found.select(F.col("row").withField("text", F.when(F.size("spans") == 0, F.col("row.text")).otherwise(text)).alias("row")).select("row.*")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for report(): every rule over every text, without an index."""
    columns, unions = [], []
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        columns.append(f"regexp_extract_all(t, '{pattern}', 0) a{i}, regexp_extract_all(t, '{pattern}', {r.group}) o{i}, regexp_split_to_array(t, '{pattern}') p{i}")
        size = lambda x, n: f"coalesce(list_sum(list_transform({x}[1:{n}], lambda v: length(v))), 0)"
        start = f"({size(f'p{i}', 'k')} + {size(f'a{i}', 'k - 1')})::bigint"
        unions.append(f"list_transform(list_filter(range(1, len(a{i}) + 1), lambda k: length(o{i}[k]) >= {r.least}), lambda k: {{'s': {start}, 'r': {i}, 'e': {start} + length(a{i}[k])}})")
    base = [i for i, r in enumerate(rules) if r.base]
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    shown = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: {kinds}[s.r + 1] || ':' || s.s || ':' || s.e), ','), '')"
    counts = ", ".join(f"len(list_filter(sp, lambda s: s.r = {i})) AS n_{rules[i].kind}" for i in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
m AS (SELECT doc_id, {', '.join(columns)} FROM d),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(unions)}])) sp FROM m)
SELECT doc_id, {counts}, sha256({shown(f"list_filter(sp, lambda s: s.r IN ({', '.join(map(str, base))}))")}) AS base_sha256, {shown('sp')} AS spans FROM s"""


def reference(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """start, rank and end of all secrets by plain search; tests compare with it."""
    return sorted((m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least)
