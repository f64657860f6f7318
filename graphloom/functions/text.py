"""Column functions over text, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.sources.languages import BRANCH

#: Kinds of nodes by the short names that commands take.
KINDS = {"fn": "Function", "func": "Function", "function": "Function", "cls": "Class", "class": "Class", "file": "File", "dir": "Dir", "module": "Dir", "lib": "Library", "library": "Library"}
#: First segments of package names that stand with their second, and heads that are no library.
DNS_ROOTS = ("org", "com", "io", "net", "javax", "jakarta", "edu", "gov", "uk", "co", "dev", "cloud", "app", "me")
NO_LIBRARY = ("from", "import", "require", "include", "use", "package", "module", "export", "default", "as")


def escape_like(text: str) -> str:
    """Text with LIKE's wildcards made literal."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


#: A to Z in lower case; other letters keep their case when what users type is compared.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def folded_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def like_ci(column: Column, text: str) -> Column:
    """Whether a column holds the text anywhere, whatever the case of A to Z."""
    return folded(column).contains(folded_text(text))


def kinds_of(text: str | None) -> list[str] | None:
    """Node kinds from a comma or space list; unknown names pass as they are."""
    return [KINDS.get(k.lower(), k) for k in text.replace(",", " ").split()] if text else None


def conf_tag(conf: Column) -> Column:
    return F.when(conf >= 0.95, "").when(conf >= 0.8, " ~").otherwise(" ?")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalised(path: Column) -> Column:
    """A path without '.', empty and resolved '..' segments; leading '..' stay."""
    step = lambda acc, p: (
        F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    # most paths have no such segment, and going through all segments costs much more than looking for one
    odd = path.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(odd, F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def library_name(raw: Column) -> Column:
    """The library that an unresolved import names, or null: its head segment if that is a fit name."""
    bare = lambda x: F.regexp_replace(x, r"""^[<>"'\s]+|[<>"'\s]+$""", "")
    text = bare(raw)
    first = F.get(F.split(text, r"[/\\]"), F.lit(0))
    by_path = F.when(first.isin(".", ".."), text).otherwise(first)
    segments = F.filter(F.split(text, r"\."), lambda p: p != "")
    head = F.get(segments, F.lit(0))
    by_dots = F.when(head.isin(*DNS_ROOTS) & (F.size(segments) > 1), F.concat_ws(".", head, F.get(segments, F.lit(1)))).otherwise(head)
    name = bare(F.when(text.rlike(r"[/\\]"), by_path).when(F.contains(text, F.lit(".")), by_dots).otherwise(F.get(F.split(text, ":"), F.lit(0))))
    parts = F.split(name, r"\.")
    fit = F.length(name).between(1, 40) & ~F.get(parts, F.lit(0)).isin(*NO_LIBRARY) & F.forall(parts, lambda p: p.rlike(r"^@?[A-Za-z_][\w.\-]*$"))
    return F.when(fit, name)


def line_facts(text: Column) -> dict[str, Column]:
    """loc, blank and code lines, branches and the deepest indentation of a text."""
    lines = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\n"))
    width = lambda line: F.floor(F.length(F.regexp_replace(F.regexp_extract(line, r"^([ \t]*)", 1), "\t", "    ")) / 4)
    blank = F.size(F.filter(lines, lambda x: ~x.rlike(r"[^ \t\r]")))
    return {
        "loc": F.size(lines).cast("long"),
        "blank_lines": blank.cast("long"),
        "code_lines": (F.size(lines) - blank).cast("long"),
        "branches": F.coalesce(F.regexp_count(text, F.lit(BRANCH)), F.lit(0)).cast("long"),
        "max_nesting": F.coalesce(F.array_max(F.transform(lines, width)), F.lit(0)).cast("long"),
        "hash": F.sha1(F.coalesce(text, F.lit(""))),
        "est_tokens": F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long"),
    }


def duplicate_ids(path: str, name: str, digest: str) -> Column:
    """s:path#name, with the first six hex digits of the body's digest (SHA-1) where a name repeats."""
    from pyspark.sql.window import Window

    same = Window.partitionBy(path, name)
    twin = F.row_number().over(Window.partitionBy(path, name, digest).orderBy("line"))
    disc = F.when(F.count(F.lit(1)).over(same) == 1, "").otherwise(F.concat(F.lit("~"), F.substring(digest, 1, 6), F.when(twin > 1, F.concat(F.lit("."), twin.cast("string"))).otherwise("")))
    return F.concat(F.lit("s:"), F.col(path), F.lit("#"), F.col(name), disc)
