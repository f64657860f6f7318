"""Jaccard join of shingle sets by parity sketches.

A parity sketch has a bit for each place that an element can hash to, and every element flips
its bit. Elements that two sets share cancel out, so sketches differ in no more bits than the
sets differ in elements. A link of `percent` asks that sets of a and b elements differ in no
more than (100 - percent) * (a + b) / (100 + percent) elements, which is used twice:

1. Sizes are cut into bands, so that linked sets lie in one band or in two that adjoin. The
   sketch of a band has four words of 64 bits more than the largest number of elements in which
   sets that meet there may differ, so by the pigeonhole principle at least four of its
   words are equal. Each set has a sketch for its own band and one for the band below, and sets with
   an equal word in a place share a bucket, linked ones four. No link is missed.
2. A second sketch of 512 bits, whatever the band, bounds the difference of a pair before
   anything is verified, and a third one does so for large sets, with as many bits as they need.

Equal sets become one node first. Keys of words are dealt to parts in blocks; a key that many
sets of a block have is known to be shared and goes round the parts, so no part holds more of
a key than a few entries a block. In every bucket a central node leads and is verified against
the others on full sets; components of these links are formed, and only pairs that lie in
different components of a bucket are left. While those are many, further leaders follow. What is
left is met pair by pair, in blocks dealt over tasks; as linked pairs share four buckets, each
node leaves out the three most crowded of its own. Pairs of large sets, for which 512 bits are
few, must pass 4,096 bits before their third sketches are looked up.

Null, empty and blank texts have no words, an empty set and no links; their component is their
own id. Repeated rows are copies; a null id belongs to the component of its set, whose id is
null only where no member has one; ties between leaders fall to the least node; extra columns,
whatever their names, play no part; an empty table gives no rows. Texts are read whole, and a
long one only has more words in its sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import discard, durable, sweep, together
from graphloom.llm.common import rows, small, word_bytes
from graphloom.llm.components import components
from graphloom.llm.near_dedup import _links, _Words, digest, mixed
from graphloom.llm.spread import hot_keys, spread_join

WORDS, PERCENT = 4, 85
#: Words of a sketch that linked sets share at least.
SHARED = 4
#: Longs of the second sketch.
FOLD = 8
#: Elements from which on a set has a third sketch, of some four bits an element.
TALL = 512
#: Elements from which on a set has the third sketch folded to so many longs too.
LARGE, BROAD = 1024, 64
#: Remainders of text hashes by which texts that no pair asks for are told from others before they are dealt.
ASKED = 1 << 18
#: Bytes of keys in a block and in a part; sets of a block with a key that make it go round the parts.
BLOCK_BYTES, PART_BYTES, BUSY = 4 << 20, 16 << 20, 32
#: Nodes of a bucket that are listed pair by pair in one task.
BLOCK_NODES = 256
#: Comparisons for each member of a bucket from which on further leaders follow.
SPLIT = 64
#: Rows of buckets that are met pair by pair at once, and the most slices that they are cut into for it.
SLICE_ROWS, MOST_SLICES = 3_000_000, 16
#: A round of leaders follows another if that has left no more than this share of comparisons.
SHRINK = 0.75

_PLACE = np.random.default_rng(0x9A71).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BAND, _SEGMENT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def token_set(words: list[bytes], known: dict, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; of all its words as one where they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(mixed(total))


def differ(a: int, b: int, percent: int = PERCENT) -> int:
    """The most elements in which linked sets of a and b elements differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def edges(percent: int = PERCENT, most: int = 1 << 40) -> list[int]:
    """The least size of each band: what is linked with a set of one band lies no further than in the next."""
    out = [1, 2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return out


def segments(band: int, cut: list[int], percent: int = PERCENT) -> int:
    """Words of a band's sketch; 0: sets that meet in it are linked only if they are equal."""
    least = cut[band + 1] - 1
    d = differ(least, min(cut[band + 2] - 1, 100 * least // percent), percent)
    return d + SHARED if d else 0


def parity(elements: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of a set in so many words of 64 bits."""
    place = ((elements >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64) * 64 + (elements & np.uint64(63)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view("<u8")


def fold(elements: np.ndarray) -> np.ndarray:
    """The second sketch, of bits that the first does not look at."""
    return parity(mixed(elements ^ _SEGMENT), FOLD)


def tall(elements: np.ndarray) -> bytes | None:
    """The third sketch: a power of two of words, so that the longer of two can be folded to the shorter."""
    return parity(mixed(elements ^ _BAND), 1 << (len(elements) // 16).bit_length()).tobytes() if len(elements) >= TALL else None


def broad(elements: np.ndarray) -> np.ndarray | None:
    """The third sketch of a large set, folded to a fixed number of longs."""
    return parity(mixed(elements ^ _BAND), BROAD).view("<i8") if len(elements) >= LARGE else None


def _no_further(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose third sketches, where both have one, differ in no more bits than linked sets differ in elements."""
    for batch in small(batches):
        keep = []
        for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "a_tall", "b_tall")), strict=True):
            if x is None or y is None:
                keep.append(True)
                continue
            x, y = (np.frombuffer(t, "<u8") for t in sorted((x, y), key=len))
            while len(y) > len(x):
                y = y[::2] ^ y[1::2]
            keep.append((100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def word_keys(sketch: np.ndarray, band: int) -> np.ndarray:
    """A key for each word of a band's sketch."""
    salt = np.arange(1, len(sketch) + 1, dtype=np.uint64) * _SEGMENT + np.array([band + 1], np.uint64) * _BAND
    return mixed(mixed(sketch ^ salt) + salt)


def keys_of(elements: np.ndarray, cut: list[int], percent: int = PERCENT) -> np.ndarray:
    """The keys of a set, in the band below and in its own."""
    band = int(np.searchsorted(cut, len(elements), side="right")) - 1
    found = [word_keys(parity(elements, n), b) for b in (band - 1, band) if b >= 0 and (n := segments(b, cut, percent))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


SKETCHED = "doc_id {id}, text_hash long, n_shingles long, row long, node binary, keys binary, fold array<long>, tall binary, broad array<long>"


def _sketched(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut, at = _Words(), edges(percent), TaskContext.get().partitionId() << 33
        for batch in small(batches):
            sets = [token_set(word_bytes(t), known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), pa.array(range(at, at + len(sets)), pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([keys_of(s, cut, percent).astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([fold(s).view("<i8") if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([tall(s) for s in sets], pa.binary()), pa.array([broad(s) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "row", "node", "keys", "fold", "tall", "broad"],
            )
            at += len(sets)

    return run


def _dealt(parts: int):
    """Blocks of keys, cut by part: part, keys and rows. Parts from `parts` on hold what is known to be shared."""

    def block(sets: dict[bytes, tuple[int, np.ndarray]], at: int) -> pa.RecordBatch:
        rows_ = np.repeat(np.array([r for r, _ in sets.values()], np.int64), [len(k) for _, k in sets.values()])
        keys = np.concatenate([k for _, k in sets.values()])
        order = np.lexsort((rows_, keys))
        keys, rows_ = keys[order], rows_[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        busy = np.repeat(many := np.diff(np.r_[begin, len(keys)]) >= BUSY, np.diff(np.r_[begin, len(keys)]))
        # a busy key leaves one entry in its part, with no row, as a sign that it is shared
        part = np.r_[np.where(busy, parts + at % parts, ((keys >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)), ((keys[begin[many]] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)]
        keys, rows_ = np.r_[keys, keys[begin[many]]], np.r_[rows_, np.full(int(many.sum()), -1)]
        order = np.argsort(part, kind="stable")
        own, first = np.unique(part[order], return_index=True)
        ends = np.r_[first[1:], len(part)]
        slices = [order[b:e] for b, e in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int64()), "keys": pa.array([keys[s].tobytes() for s in slices], pa.binary()), "rows": pa.array([rows_[s].tobytes() for s in slices], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        at, held = TaskContext.get().partitionId() * 7919, 0
        for row, node, keys in rows(batches, "row", "node", "keys"):
            if node in sets or not keys:
                continue
            sets[node] = row, np.frombuffer(keys, "<u8")
            held += len(keys)
            if held >= BLOCK_BYTES:
                yield block(sets, at)
                sets, at, held = {}, at + 1, 0
        if sets:
            yield block(sets, at)

    return run


def _shared(parts: int):
    def run(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, "<u8") for k in group.column("keys").to_pylist()])
        rows_ = np.concatenate([np.frombuffer(r, "<i8") for r in group.column("rows").to_pylist()])
        if group.column("part")[0].as_py() < parts:
            order = np.argsort(keys, kind="stable")
            keys, rows_ = keys[order], rows_[order]
            same = keys[1:] == keys[:-1]
            keep = (np.r_[same, False] | np.r_[False, same]) & (rows_ >= 0)
            keys, rows_ = keys[keep], rows_[keep]
        return pa.table({"key": pa.array(keys.view(np.int64), pa.int64()), "row": pa.array(rows_, pa.int64())})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of nodes. Copies of a text come to one task, and the first of them is enough."""
    known, seen = _Words(), set()
    for batch in small(batches):
        fresh = [(node, text) for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True) if node not in seen and not seen.add(node)]
        yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in fresh], pa.binary()), pa.array([token_set(word_bytes(t), known).astype("<u8").tobytes() for _, t in fresh], pa.binary())], names=["node", "elements"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, on full sets, which are made of the texts of the pairs' nodes alone."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    ends = durable(ends.join(nodes.select("node", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("text_hash")), "node"), "parity-ends")
    docs = _asked(docs, ends)
    texts = docs.join(ends, (docs["text_hash"] == ends["text_hash"]) & docs["doc_id"].eqNullSafe(ends["_id"])).select("node", "text")
    sets = durable(texts.mapInArrow(_sets, "node binary, elements binary"), "parity-sets")
    discard(ends)
    sweep(docs.sparkSession)
    links = _links(pairs, sets, percent).distinct()
    discard(sets)
    return links


def _asked(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """docs without most of those whose text_hash ends does not have; they need not be dealt to be left out."""
    rest = lambda df: F.pmod(df["text_hash"], F.lit(ASKED)).alias("_rest")
    return docs.select("*", rest(docs)).join(F.broadcast(ends.select(rest(ends)).distinct()), "_rest", "left_semi").drop("_rest")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the sizes, and the bits of the second sketches, differ by no more than linked sets differ in elements."""
    f = lambda side: F.col(f"{side}_fold")
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.get(f(x), F.lit(i)).bitwiseXOR(F.get(f(y), F.lit(i)))) for i in range(FOLD)])
    most = (100 - percent) * (F.col(f"{x}_n") + F.col(f"{y}_n"))
    return ((100 + percent) * F.abs(F.col(f"{x}_n") - F.col(f"{y}_n")) <= most) & ((100 + percent) * apart <= most)


def _broadly(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs but for those of two large sets whose folded third sketches differ in more bits than linked sets differ in elements."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("broad").alias(f"{side}_broad")), side)
    bits = F.zip_with("a_broad", "b_broad", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    return pairs.filter(F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")), F.lit(True))).select("a", "b")


def _as(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({"node": side, "n": f"{side}_n", "fold": f"{side}_fold"})


def _led(members: DataFrame, nodes: DataFrame, wide: DataFrame, percent: int, done: DataFrame | None, rest: Column) -> DataFrame:
    """Pairs of each bucket's most central node that `rest` admits with those elsewhere, if they share buckets enough; members: key, node, share, label."""
    lead = members.filter(rest).groupBy("key").agg(F.min(F.struct(-F.col("share"), "node", "label")).alias("l")).select("key", F.col("l.node").alias("a"), F.col("l.label").alias("a_label"))
    met = spread_join(members.withColumnsRenamed({"node": "b", "label": "b_label"}), lead, "key", "b", wide).filter("a_label <> b_label")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= SHARED).drop("_n")
    pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        pairs = pairs.join(_as(nodes.select("node", "n", "fold"), side), side)
    return _closer(pairs.filter(_may_link("a", "b", percent)).select("a", "b"), nodes, percent)


def _closer(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the third sketches admit too."""
    stored = durable(pairs, "parity-near")
    for side in ("a", "b"):
        pairs = (stored if side == "a" else pairs).join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("tall").alias(f"{side}_tall")), side)
    slim = pairs.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_tall", "b_tall")
    found = durable(slim.mapInArrow(lambda batches: _no_further(batches, percent), "a binary, b binary"), "parity-pairs")
    discard(stored)
    return found


def labelled(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and label, the component's name, of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = durable(docs.mapInArrow(_sketched(percent), SKETCHED.format(id=kind)), "parity-sketches")
    size = int(sketched.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)

    shared = sketched.filter("n_shingles > 0").select("row", "node", "keys").mapInArrow(_dealt(parts), "part long, keys binary, rows binary").groupBy("part").applyInArrow(_shared(parts), "key long, row long")
    found = durable(shared.join(sketched.select("row", "node"), "row").select("key", "node").distinct(), "parity-shared")
    sweep(spark)
    # copies of a set stand for one node, found again by the id and text hash of one of them
    nodes = durable(sketched.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("fold").alias("fold"), F.first("tall").alias("tall"), F.first("broad").alias("broad"), F.first(F.octet_length("keys") / 8).alias("n_keys"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("copies")), "parity-nodes")
    every = durable(sketched.select("doc_id", "n_shingles", "node"), "parity-rows")
    discard(sketched)
    sweep(spark)
    crowded = durable(found.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "parity-crowded")
    wide = durable(hot_keys(crowded, "key", "many", crowded.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]), "parity-wide")
    buckets = durable(spread_join(found, crowded.select("key"), "key", "node", wide), "parity-buckets")
    # a node in fewer shared buckets than linked sets have in common has no link
    share = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= SHARED).join(nodes, "node").select("node", (F.col("met") / F.col("n_keys")).alias("share"))
    members = durable(buckets.join(share, "node").withColumn("label", F.col("node")), "parity-members")
    discard(found, crowded, buckets)

    total = members.count()
    done = _led(members, nodes, wide, percent, None, F.lit(True))
    sweep(spark)
    links = _verified(done, docs, nodes, percent)
    labels = components(links)
    open_ = _still_open(members, labels, wide)
    discard(members)
    # further leaders, from outside the largest component, while pairs outnumber what a leader meets and get fewer
    cost, before_ = _comparisons(open_), math.inf
    while SPLIT * total < cost < SHRINK * before_:
        pairs = _led(open_, nodes, wide, percent, done, F.col("label") != F.col("major"))
        new = _verified(pairs, docs, nodes, percent)
        done = done.unionByName(pairs)
        if not new.limit(1).count():
            break
        links = links.unionByName(new)
        labels, before = components(links), open_
        open_ = _still_open(open_.drop("major", "many", "minor"), labels, wide)
        discard(before)
        cost, before_ = _comparisons(open_), cost
    sweep(spark)
    pairs = _apart(open_, nodes, percent, done)
    discard(open_)
    if pairs.limit(1).count():
        more = _verified(pairs, docs, nodes, percent)
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    sweep(spark)
    copied = hot_keys(nodes, "node", "copies", every.count())
    named = spread_join(every, labels, "node", "doc_id", copied, "left")
    return durable(named.withColumn("label", F.coalesce("label", "node")).drop("node"), "parity-documents")


def _still_open(members: DataFrame, labels: DataFrame, wide: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their labels; of the bucket: major, its largest component, and the nodes, many, and minor of them elsewhere."""
    now = durable(members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "parity-labelled")
    found = durable(spread_join(now, _mixed(now), "key", "node", wide), "parity-open")
    discard(now)
    return found


def _comparisons(open_: DataFrame) -> int:
    return open_.agg(F.coalesce(F.sum("minor"), F.lit(0))).first()[0]


def _mixed(members: DataFrame) -> DataFrame:
    """key, major, many and minor of the buckets that hold several components."""
    each = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    size = F.struct("_n", "label")
    return each.groupBy("key").agg(F.max(size)["label"].alias("major"), F.sum("_n").alias("many"), (F.sum("_n") - F.max("_n")).alias("minor")).filter("minor > 0")


def _limits(open_: DataFrame) -> DataFrame:
    """node and limit: the size and key of the most crowded open bucket in which a node is met pair by pair.

    Sets that link share at least SHARED buckets, all of them open while the sets lie in different
    components. Of these the least crowded is within the limits of both: a node leaves out its
    SHARED - 1 most crowded ones, in an order that is the same for all. A node in fewer has no limit.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("many"), F.desc("key")))
    ranked = open_.select("node", "many", "key").withColumn("_place", place).filter(F.col("_place") <= SHARED)
    return ranked.filter(F.col("_place") == SHARED).select("node", F.struct("many", "key").alias("limit"))


def _apart(open_: DataFrame, nodes: DataFrame, percent: int, done: DataFrame) -> DataFrame:
    """The pairs that may link and lie in different components of a bucket: one of them is outside the largest."""
    limited = durable(nodes.select("node", "n", "fold").join(_limits(open_), "node"), "parity-limits")
    sweep(nodes.sparkSession)
    n = max(1, min(MOST_SLICES, -(-open_.count() // SLICE_ROWS)))
    parts = []
    for i in range(n):
        own = F.lit(True) if n == 1 else F.pmod(F.xxhash64("key"), F.lit(n)) == i
        parts.append(_met(open_.filter(own), limited, percent))
        sweep(nodes.sparkSession)
    # a pair can be met in several slices
    met = together(parts).distinct().join(done, ["a", "b"], "left_anti")
    pairs = _closer(_broadly(met, nodes, percent), nodes, percent)
    discard(limited, *parts)
    return pairs


def _met(open_: DataFrame, limited: DataFrame, percent: int) -> DataFrame:
    """a and b: the pairs that may link and meet in these buckets, outside of a component; written."""
    blocks, own = lambda c: F.ceil(F.col(c) / BLOCK_NODES).cast("int"), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = F.col("label") != F.col("major")
    fine = durable(open_.join(limited, "node").filter(F.struct("many", "key") <= F.col("limit")).drop("share", "limit"), "parity-dealt")
    side = lambda s, rows_, one, two: _as(rows_.select("key", "node", "n", "fold", F.col("label").alias(f"{s}_label"), outside.alias(f"{s}_out"), one.alias("one"), two.alias("two")), s)
    x = side("x", fine.filter(outside), own(blocks("minor")), every(blocks("many")))
    y = side("y", fine, every(blocks("minor")), own(blocks("many")))
    met = x.join(y, ["key", "one", "two"]).filter((~F.col("y_out") | (F.col("x") < F.col("y"))) & (F.col("x_label") != F.col("y_label")) & _may_link("x", "y", percent))
    found = durable(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "parity-met")
    discard(fine)
    return found


def components_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    named = labelled(docs, percent)
    least = durable(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "parity-least")
    found = spread_join(named, least.drop("n"), "label", "doc_id", hot_keys(least, "label", "n", named.count()), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
