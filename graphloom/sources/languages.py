"""Nineteen languages: extensions, comments and the patterns of their declarations and imports."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|open|sealed|async|virtual|inline|export|default|data|native|synchronized|suspend|operator|infix|partial|extern|unsafe|const|pub(?:\([^)]*\))?|case|lazy|implicit|mutating|fileprivate|required|convenience|external|factory|readonly|strictfp|new)\s+)*"
_TYPE = r"[A-Za-z_][\w.:<>,\[\]?*&\s]*?"


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    functions: tuple[str, ...]
    types: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    triple: bool = False
    chars: bool = True  # a single quote opens a string or character
    compiled: dict = field(default_factory=dict, compare=False, hash=False)


_C_CALLABLE = rf"^(?:{_TYPE}[\s*&]+)(?:\w+::)*(?P<name>~?\w+)\s*\([^;]*\)\s*(?:const|noexcept|override|final)*\s*(?:\{{|$)"

LANGUAGES = (
    Language("python", (".py", ".pyw"), (r"^\s*(?:async\s+)?def\s+(?P<name>\w+)",), (r"^\s*class\s+(?P<name>\w+)",), (r"^\s*import\s+(?P<name>[\w.]+)", r"^\s*from\s+(?P<name>[\w.]+)\s+import"), ("#",), None, triple=True),
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_ID}\s*=>)", rf"^\s+{_MODS}(?:get\s+|set\s+|\*)?(?P<name>{_ID})\s*\([^;=]*\)\s*\{{"), (rf"^\s*(?:export\s+)?(?:default\s+)?class\s+(?P<name>{_ID})",), (r"""\bfrom\s+['"](?P<name>[^'"]+)['"]|^\s*import\s+['"](?P<bare>[^'"]+)['"]""", r"""\brequire\(\s*['"](?P<name>[^'"]+)['"]""")),
    Language("typescript", (".ts", ".tsx"), (rf"^\s*{_MODS}function\s*\*?\s*(?P<name>{_ID})", rf"^\s*(?:export\s+)?(?:const|let)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>)?\([^)]*\)\s*(?::[^=]+)?=>|{_ID}\s*=>)", rf"^\s+{_MODS}(?:get\s+|set\s+)?(?P<name>{_ID})\s*(?:<[^>]*>)?\([^;=]*\)\s*(?::[^{{;]+)?\{{"), (rf"^\s*{_MODS}(?:class|interface|enum|namespace)\s+(?P<name>{_ID})",), (r"""\bfrom\s+['"](?P<name>[^'"]+)['"]|^\s*import\s+['"](?P<bare>[^'"]+)['"]""", r"""\brequire\(\s*['"](?P<name>[^'"]+)['"]""")),
    Language("java", (".java",), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s+)?{_TYPE}\s+(?P<name>\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w.,\s]+)?\s*[{{;]", r"^\s*(?:public|protected|private)\s+(?P<name>[A-Z]\w*)\s*\([^;=]*\)\s*(?:throws\s+[\w.,\s]+)?\s*\{"), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)",), (r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+)",), triple=True),
    Language("kotlin", (".kt", ".kts"), (rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*\(",), (rf"^\s*{_MODS}(?:annotation\s+|enum\s+|inner\s+|value\s+)?(?:class|interface|object)\s+(?P<name>\w+)",), (r"^\s*import\s+(?P<name>[\w.]+)",), triple=True),
    Language("go", (".go",), (r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(]",), (r"^\s*type\s+(?P<name>\w+)\s+(?:struct|interface|func|map|\w)",), (r'^\s*import\s+(?:[\w.]+\s+)?"(?P<name>[^"]+)"', r'^\s+(?:[\w.]+\s+)?"(?P<name>[\w./-]+)"\s*$'), chars=False),
    Language("rust", (".rs",), (rf"^\s*{_MODS}(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)",), (rf"^\s*{_MODS}(?:struct|enum|trait|union|mod)\s+(?P<name>\w+)",), (r"^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+(?P<name>[\w:]+)",), chars=False),
    Language("c", (".c", ".h"), (_C_CALLABLE,), (r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{?",), (r'^\s*#\s*include\s+[<"](?P<name>[^>"]+)[>"]',)),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".c++"), (_C_CALLABLE,), (r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?:\s+class)?|namespace|union)\s+(?P<name>\w+)",), (r'^\s*#\s*include\s+[<"](?P<name>[^>"]+)[>"]',)),
    Language("csharp", (".cs",), (rf"^\s*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:<[^>]+>)?\([^;=]*\)\s*(?:where[^{{]+)?(?:\{{|=>|;|$)",), (rf"^\s*{_MODS}(?:class|interface|struct|enum|record)\s+(?P<name>\w+)",), (r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;",)),
    Language("ruby", (".rb",), (r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)",), (r"^\s*(?:class|module)\s+(?P<name>[\w:]+)",), (r"""^\s*require(?:_relative)?\s+['"](?P<name>[^'"]+)['"]""",), ("#",), None),
    Language("php", (".php",), (rf"^\s*{_MODS}function\s+&?(?P<name>\w+)\s*\(",), (rf"^\s*{_MODS}(?:class|interface|trait|enum)\s+(?P<name>\w+)",), (r"^\s*use\s+(?P<name>[\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"](?P<name>[^'"]+)['"]"""), ("//", "#")),
    Language("swift", (".swift",), (rf"^\s*(?:@\w+\s+)*{_MODS}func\s+(?P<name>\w+)",), (rf"^\s*(?:@\w+\s+)*{_MODS}(?:class|struct|enum|protocol|actor|extension)\s+(?P<name>\w+)",), (r"^\s*(?:@testable\s+)?import\s+(?P<name>[\w.]+)",), chars=False),
    Language("scala", (".scala", ".sc"), (rf"^\s*{_MODS}def\s+(?P<name>\w+)",), (rf"^\s*{_MODS}(?:class|object|trait|enum)\s+(?P<name>\w+)",), (r"^\s*import\s+(?P<name>[\w.]+)",), triple=True),
    Language("dart", (".dart",), (rf"^\s*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{{|=>)",), (rf"^\s*{_MODS}(?:class|mixin|enum|extension)\s+(?P<name>\w+)",), (r"""^\s*(?:import|export|part)\s+['"](?P<name>[^'"]+)['"]""",)),
    Language("shell", (".sh", ".bash", ".zsh"), (r"^\s*(?:function\s+(?P<name>[\w-]+)|(?P<bare>[\w-]+)\s*\(\s*\))",), (), (r"^\s*(?:source|\.)\s+(?P<name>[\w./-]+)",), ("#",), None),
    Language("lua", (".lua",), (r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)",), (), (r"""\brequire\s*\(?\s*['"](?P<name>[^'"]+)['"]""",), ("--",), ("--[[", "]]")),
    Language("r", (".r", ".R"), (r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(",), (), (r"""^\s*(?:library|require|source)\(\s*['"]?(?P<name>[\w./]+)""",), ("#",), None),
    Language("elixir", (".ex", ".exs"), (r"^\s*defp?\s+(?P<name>\w+[?!]?)",), (r"^\s*def(?:module|protocol)\s+(?P<name>[\w.]+)",), (r"^\s*(?:import|alias|use|require)\s+(?P<name>[\w.]+)",), ("#",), None),
)

BY_NAME = {language.name: language for language in LANGUAGES}
EXTENSIONS = {extension: language.name for language in LANGUAGES for extension in language.extensions}
#: Documents and configuration by extension, and endings of files that are never read as code.
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".adoc")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".xml", ".gradle")
SKIPPED_SUFFIXES = (".min.js", ".min.css", ".map", ".lock", ".bundle.js", "-lock.json", ".d.ts")
#: What marks documentation, and what marks types, by language.
DOC_MARKERS = {"python": "\"\"\"|'''", "javascript": r"/\*\*", "typescript": r"/\*\*", "java": r"/\*\*", "kotlin": r"/\*\*", "rust": r"///|/\*\*", "csharp": r"///", "dart": r"///"}
TYPE_HINTS = {
    "python": r"->\s*[\w\[\], .]+:|:\s*[A-Z]\w+",
    "typescript": r":\s*[A-Za-z_$][\w$<>\[\], |]*",
    "java": r"\b(?:int|long|double|float|boolean|String|char|byte|short|void|[A-Z]\w+)\b",
    "rust": r"->\s*[\w:<>&\[\], ]+|:\s*[A-Z]\w+",
}
#: Names before a parenthesis that are no calls, or none that tells anything.
STOPWORDS = frozenset(
    """
    if else elif for while switch case catch except finally try do return yield
    and or not in is new delete typeof instanceof sizeof throw throws await async
    func def fun function class struct enum interface trait impl module package
    import from export const let var static public private protected internal
    print println printf fprintf sprintf format echo log warn error info debug
    len str int float bool list dict set tuple map filter reduce range enumerate
    zip sorted reversed min max sum abs round type isinstance getattr setattr
    hasattr super self this null nil none true false void string number boolean
    array object array_merge count push pop shift append add remove get put
    """.split()
)
#: Words that begin a statement and no declaration, and names that no function has.
STATEMENT_STARTERS = frozenset(
    """
    return throw throws raise new delete yield await assert del print if else elif
    for while do switch case break continue goto try catch except finally with
    using lock defer go when guard match super this echo require include unset
    """.split()
)
NOT_NAMES = ("if", "for", "while", "switch", "catch", "return", "function")
#: Lines shaped like a declaration, and words that take a clause and declare nothing.
DECLARATION_SHAPE = (
    r"^\s*(?:@\w+\s*(?:\([^)]*\))?\s*)*"
    r"(?:[A-Za-z_$][\w<>\[\].,?$]*\s+)+"
    r"([A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*"
    r"(?:const\s*|noexcept\s*|throws[\w., ]*)?[{;]?\s*$"
)
DECLARATION_KEYWORD = (
    r"^\s*(?:(?:pub|public|private|protected|internal|static|final|abstract|"
    r"open|override|suspend|async|inline|export|default|sealed|data|value)\s+)*"
    r"(?:def|fun|func|fn|sub|class|struct|trait|impl|interface|enum|record|"
    r"object|module|protocol|extension)\s+[A-Za-z_$]"
)
NOT_DECLARED = frozenset(
    """
    if else elif for while switch case do try catch except finally return yield
    throw throws raise synchronized assert with using lock when guard defer go
    await new match del print exec eval super this self lambda not and or is in
    """.split()
)
#: What counts as a branch.
BRANCH = (
    r"\b(if|else\s+if|elif|for|foreach|while|case|when|catch|except|"
    r"rescue|and|or)\b|&&|\|\||\?\?|(?<![=!<>])\?(?!\?)"
)
BRANCHES = re.compile(BRANCH)
