"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: lines of a text, short ones together, and long lines cut further at
places their words choose, so that an edit moves only the cuts beside it. Where no word ends a
leaf in time, a rolling hash of code points chooses, and a leaf of the largest size is cut in
any case. Leaves grow with their distance from the start of a text, so that short texts have
several and long ones no more than they need. A digest is the first 16 bytes of a SHA-256; a
leaf's is that of its bytes. A section is a run of paragraphs that ends where a leaf's digest
says so; its digest is that of its children's digests and sizes, and sections are grouped in the
same way, level by level, until one node is left. The root thus follows from its children only,
and equal roots mean equal texts. The fingerprint writes root and leaves as text, from which the
levels between are grown again. Likeness walks down from the roots: equal nodes are settled
without their children, and only the differing branches are opened, to the leaves.

Documents in ascending order of id (nulls first, equal ids by text hash) have a next one;
the last is followed by the first. They are cut into ranges by sampled splitters, and the
first of each range goes along to the range before it, so the order needs one shuffle.

Null texts are empty texts, equal texts have equal fingerprints, an empty text is like an
empty text only. Repeated rows follow each other; a table of one row is followed by itself.
Extra columns play no part, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import durable
from graphloom.llm.common import small
from graphloom.llm.splitters import range_of, ranges


@dataclass(frozen=True)
class _Cut:
    """How leaves are cut that begin at code point `begin` of a text or later.

    A leaf of at least `least` code points ends at a line end or after a word whose hash is 0
    modulo `words`. One longer than `most` is cut where the hash of the last `WINDOW` code
    points is 0 modulo `points`, `most` // 4 (more than WINDOW) after the last cut at the
    earliest and `most` at the latest.
    """

    begin: int
    least: int
    words: int
    points: int
    most: int


#: Leaves grow with their distance from the start, so that short texts have several and long ones few.
#: Each modulus divides the next, so an edit moves only the cuts beside it. Cuts follow from what is
#: before them, and no leaf is longer than 0.5 of its begin (but for the first, of 64): a text of 500
#: code points or more whose last half is replaced keeps a likeness of a third at least.
CUTS = [_Cut(begin, size // 2, size // 16, size // 2, 2 * size) for begin, size in ((0, 32), (256, 64), (640, 128), (1_280, 256), (2_560, 512), (8_192, 1_024))]
BEGINS = [cut.begin for cut in CUTS]
WINDOW = 8
#: Code points that are hashed at once.
STEP = 1 << 20
#: A node ends its parent if its digest is 0 modulo this, and if the parent has that many children.
CHILDREN, MOST_CHILDREN = 8, 64
#: Bytes of a digest.
DIGEST = 16
RANGE_BYTES = 8 << 20
MOST_RANGES = 65_536

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def _cut_points(text: str) -> dict[_Cut, list[int]]:
    """For each cut, after which code points of the text the hash of the last few says that a long leaf may end."""
    found: dict[_Cut, list[int]] = {cut: [] for cut in CUTS}
    for begin in range(0, len(text), STEP):
        low = max(0, begin - WINDOW + 1)
        points = np.frombuffer(text[low : begin + STEP].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = np.zeros(len(points), np.uint64)
        for k in range(WINDOW):
            h[k:] += points[: len(points) - k] * _POWERS[k]
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))[begin - low :] >> np.uint64(32)
        for cut, at in found.items():
            at.extend((np.flatnonzero(h % np.uint64(cut.points) == 0) + begin + 1).tolist())
    return found


def _cut_at(begin: int) -> _Cut:
    return CUTS[bisect_right(BEGINS, begin) - 1]


def paragraphs(text: str) -> list[str]:
    """The leaves of a text, in order; joined they are the text."""
    out: list[str] = []
    points: dict[_Cut, list[int]] = {}
    begin, at, cut = 0, 0, CUTS[0]

    def close(end: int) -> None:
        nonlocal begin, cut
        while end - begin > cut.most:
            if not points:
                points.update(_cut_points(text))
            near = points[cut]
            i = bisect_left(near, begin + cut.most // 4)
            stop = min(near[i] if i < len(near) else end, begin + cut.most, end)
            out.append(text[begin:stop])
            begin, cut = stop, _cut_at(stop)
        if begin < end:
            out.append(text[begin:end])
            begin, cut = end, _cut_at(end)

    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        end = at + len(line)
        if end - begin > cut.least:
            for word in line.split(" ")[:-1]:
                at += len(word) + 1
                if at - begin >= cut.least and xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % cut.words == 0:
                    close(at)
        at = end
        if end - begin >= cut.least:
            close(end)
    close(len(text))
    return out


@dataclass
class Tree:
    """Levels of nodes, leaves first, the root alone in the last: digests and weights.

    The weight of a leaf is its code points, that of any other node how many children it has.
    """

    levels: list[tuple[list[bytes], list[int]]]

    @property
    def root(self) -> bytes:
        return self.levels[-1][0][0]

    @property
    def size(self) -> int:
        """Code points under the root."""
        return sum(self.levels[0][1])


def parents(digests: list[bytes], weights: list[int]) -> tuple[list[bytes], list[int]]:
    """The level above: each parent's digest covers the digests and weights of its children.

    A child whose digest says so ends its parent, the second child at the earliest and the
    `MOST_CHILDREN`th at the latest.
    """
    out, counts, begin, last = [], [], 0, len(digests) - 1
    for i in range(max(1, len(digests))):
        n = i + 1 - begin
        if i >= last or (n > 1 and digests[i][-1] % CHILDREN == 0) or n == MOST_CHILDREN:
            n = min(n, len(digests))
            covered = b"".join(digests[begin : begin + n]) + np.array(weights[begin : begin + n], "<u8").tobytes()
            out.append(hashlib.sha256(b"\1" + covered).digest()[:DIGEST])
            counts.append(n)
            begin = i + 1
    return out, counts


def grown(leaves: tuple[list[bytes], list[int]]) -> Tree:
    """The tree over given leaves: sections over paragraphs, and more levels until one node is left."""
    levels = [leaves, parents(*leaves)]
    while len(levels[-1][0]) > 1:
        levels.append(parents(*levels[-1]))
    return Tree(levels)


class Digests(dict):
    """The digest of each leaf that was asked for."""

    def __missing__(self, leaf: str) -> bytes:
        value = self[leaf] = hashlib.sha256(b"\0" + leaf.encode("utf-8", "surrogatepass")).digest()[:DIGEST]
        return value


def tree(text: str, known: Digests | None = None) -> Tree:
    """The Merkle tree of a text; known: digests of leaves, of texts that share some."""
    pieces = paragraphs(text)
    return grown((list(map((Digests() if known is None else known).__getitem__, pieces)), list(map(len, pieces))))


def mark(t: Tree) -> str:
    """root|leaves: the root in hex, then the weights of the leaves and, in base 64, their digests; the levels between follow from them."""
    digests, weights = t.levels[0]
    return f"{t.root.hex()}|{','.join(map(str, weights))}:{base64.b64encode(b''.join(digests)).decode()}"


def parse(written: str) -> Tree:
    """The tree that mark() wrote, grown again; a root that does not follow from the leaves is an error."""
    root, _, leaves = written.partition("|")
    weights, _, digests = leaves.partition(":")
    raw = base64.b64decode(digests)
    found = grown(([raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)], [int(w) for w in weights.split(",") if w]))
    if found.root.hex() != root:
        raise ValueError("the root does not follow from the leaves")
    return found


def fingerprint(text: str) -> str:
    return mark(tree(text))


def differing(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """The places of the leaves of each that the other lacks, by opening differing nodes only."""
    level = min(len(a.levels), len(b.levels)) - 1
    opened = [list(range(len(t.levels[level][0]))) for t in (a, b)]
    while True:
        digests = [t.levels[level][0] for t in (a, b)]
        shared = Counter(digests[0][i] for i in opened[0]) & Counter(digests[1][i] for i in opened[1])
        for side in (0, 1) if shared else ():
            left, kept = Counter(shared), []
            for i in opened[side]:
                if left[digests[side][i]] > 0:
                    left[digests[side][i]] -= 1
                else:
                    kept.append(i)
            opened[side] = kept
        if not level:
            return opened[0], opened[1]
        for side, t in enumerate((a, b)):
            ends = [0, *accumulate(t.levels[level][1])]
            opened[side] = [child for i in opened[side] for child in range(ends[i], ends[i + 1])]
        level -= 1


def likeness(a: Tree, b: Tree) -> float:
    """Twice the shared code points over all, by leaves: 1 for equal roots, 0 for nothing shared."""
    every = a.size + b.size
    if a.root == b.root or not every:
        return 1.0
    alone = sum(t.levels[0][1][i] for t, own in zip((a, b), differing(a, b), strict=True) for i in own)
    return (every - alone) / every


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its range; a guest, the first of the range after, only follows."""
    before = None
    for batch in small(batches):
        out: dict[str, list] = {name.split()[0]: [] for name in OUT.split(", ")}
        for span, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "text")), strict=True):
            text = text or ""
            digests = Digests()
            grown_here = tree(text, digests)
            here = (span, doc_id, text, grown_here, mark(grown_here), digests)
            if before is not None and before[0] == span:
                _, own_id, own, own_tree, own_mark, own_digests = before
                edited = edit(own, text)
                edited_tree = tree(edited, own_digests)
                values = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, mark(edited_tree), likeness(own_tree, edited_tree), likeness(own_tree, grown_here))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            before = here
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.column("doc_id").type), pa.array(out["n_chars"], pa.int64()), *(pa.array(out[c], pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(pa.array(out[c], pa.float64()) for c in ("near_edited", "near_next"))], names=list(out))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near they are."""
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    )
    slim = durable(keyed.select("_id", "_text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("_size")), "merkle-keys")
    total = slim.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    parts = int(min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)))
    cut = ranges(slim, ["_id", "_text"], "_size", parts)
    spanned = slim.select(range_of(["_id", "_text"], cut.splitters).alias("_range"), "_id", "_text")
    first = {r["_range"]: tuple(r["_first"]) for r in spanned.groupBy("_range").agg(F.min(F.struct("_id", "_text")).alias("_first")).collect()}
    filled = sorted(first)
    # who follows the last of each range: the first of the next one that has rows
    guests = [(filled[i - 1], *first[r]) for i, r in enumerate(filled)]
    own = keyed.withColumn("_range", range_of(["_id", "_text"], cut.splitters)).withColumn("_guest", F.lit(0))
    if not guests:
        return own.mapInArrow(_walk, OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))
    known = F.broadcast(spark.createDataFrame(guests, "_to int, _gid long, _gtext long"))
    # equal keys are equal texts, so any one of them can go along
    visiting = keyed.join(known, (F.col("_id") == F.col("_gid")) & (F.col("_text") == F.col("_gtext")))
    visiting = visiting.groupBy("_to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("_id").alias("_id"), F.first("_text").alias("_text")).select("doc_id", "text", "_id", "_text", F.col("_to").alias("_range"), F.lit(1).alias("_guest"))
    dealt = own.unionByName(visiting).repartition(parts, "_range").sortWithinPartitions("_range", "_guest", "_id", "_text")
    return dealt.select("_range", "doc_id", "text").mapInArrow(_walk, OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))
