"""Java files read by the Java compiler, in batches, one process a batch.

A batch is a group of files in one Arrow task; the helper in java/Facts.java parses and
attributes them in memory, beside the headers of other files that they depend on
(java_context.py), so the size of a batch does not change what is found. Sources that are not
rows are found through the source roots, folders that all workers see. What the compiler
cannot read, and everything where no compiler is installed, is left to the patterns, as the
column frontend tells. A process that dies, runs out of memory or time, or ends early is a failure and
raises CompilerFailed.
"""

from __future__ import annotations

import re
import shutil
import struct
import subprocess
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

HELPER = Path(__file__).parent / "java" / "Facts.java"
BATCH_FILES, SECONDS, HEAP = 400, 3600, "3g"
#: Bytes of text in a batch; a file of more than a quarter of them is read alone.
BATCH_BYTES = 16 << 20
#: The compiler's heap stays near what it holds, as several may run beside each other.
_SPARING = ("-XX:+UseSerialGC", "-XX:MinHeapFreeRatio=10", "-XX:MaxHeapFreeRatio=30")
_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M)


#: How the helper ends when the compiler gives up on the files, and the line that all it tells ends with.
UNREAD, WHOLE = 4, b"E"


class CompilerFailed(RuntimeError):
    """The compiler's process has failed, so nothing is known of the files of its batch."""


@lru_cache(maxsize=1)
def available() -> bool:
    return HELPER.exists() and bool(shutil.which("java")) and bool(shutil.which("javac"))


def source_root(path: str, text: str) -> str | None:
    """The folder under which the packages of a file's tree lie; None if its folder does not follow its package."""
    folder = path.rpartition("/")[0]
    found = _PACKAGE.search(text[:8192])
    if not found:
        return folder
    tail = found[1].replace(".", "/")
    if folder == tail:
        return ""
    return folder.removesuffix("/" + tail) if folder.endswith("/" + tail) else None


def _framed(text: str) -> bytes:
    raw = text.encode("utf-8", "ignore")
    return struct.pack(">i", len(raw)) + raw


def read(files: list[tuple[str, str]], roots: list[str], around: list[tuple[str, str]] = ()) -> dict[str, dict]:
    """path -> symbols, imports and calls of the files (path, text) that the compiler understands; raises CompilerFailed.

    around: files (path, header) that calls may lead to, of which nothing is told.
    """
    if not files or not available():
        return {}
    listed = lambda rows: struct.pack(">i", len(rows)) + b"".join(_framed(x) for row in rows for x in row)
    named = lambda rows: sorted((p, t) for p, t in rows if "\t" not in p and "\n" not in p)
    payload = listed([(r,) for r in roots]) + listed(named(files)) + listed(named(around))
    try:
        ended = subprocess.run(["java", "-Xss8m", f"-Xmx{HEAP}", *_SPARING, str(HELPER)], input=payload, capture_output=True, timeout=SECONDS)
    except (OSError, subprocess.SubprocessError) as e:
        raise CompilerFailed(f"the Java compiler has not read {len(files)} files: {type(e).__name__}") from e
    told = ended.stdout
    if ended.returncode == UNREAD:
        return {}
    if ended.returncode != 0 or told.rstrip().rpartition(b"\n")[2] != WHOLE:
        raise CompilerFailed(f"the Java compiler has not read {len(files)} files and ended with {ended.returncode}: {ended.stderr[-500:].decode('utf-8', 'replace')}")
    del ended
    out: dict[str, dict] = {}
    calls: dict[str, list] = defaultdict(list)
    del payload
    # the one string of a path or a name stands for all its uses
    one: dict[str, str] = {}
    kept = lambda x: one.setdefault(x, x) or None
    for line in told.decode("utf-8", "ignore").splitlines():
        kind, _, path = line.partition("\t")
        path, *rest = path.split("\t")
        if kind == "F":
            out[path] = {"symbols": [], "imports": [], "calls": []}
        elif kind == "I" and path in out:
            # as the patterns read them: a.b.* is a.b
            out[path]["imports"].append(rest[0].split("*")[0].rstrip("."))
        elif kind == "S" and len(rest) == 6:
            name, what, first, last, parent, documented = rest
            out[path]["symbols"].append({"name": name, "kind": what, "line": int(first), "length": max(1, int(last) - int(first) + 1), "parent": parent or None, "documented": documented == "true"})
        elif kind == "C" and len(rest) == 7:
            owner, name, on, line, tag, where, at = rest
            calls[path].append({"owner": int(owner), "name": one.setdefault(name, name), "is_method": on != "", "recv": one.setdefault(on[1:], on[1:]) if on else None, "line": int(line), "cands": [], "tag": kept(tag), "tpath": kept(where), "tline": int(at) if at else None})
    for path, rows in calls.items():
        out[path]["calls"] = rows
    return out
