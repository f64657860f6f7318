"""Near-duplicates: fast similarity sketches, banding and exact verification.

A document's set holds its distinct five-word shingles, hashed to 64 bits. The sketch has
t coordinates and is filled in rounds: in each of the first t rounds every element is put
in a bin of its own choice, in round t + i into bin i, and a bin keeps the least (round,
value). Late rounds never displace early ones, and the last t make sure that each bin fills.

Equal sets become one node first. Nodes that agree in all coordinates of a band share a
bucket. Then, exactly and without listing the pairs of a group:

1. A shingle that only one candidate has cannot be shared. A node where more than
   100 - percent of 100 shingles are such has no link and goes.
2. In each bucket the node with the smallest share of unshared shingles leads, and every
   other member is verified against it on full sets: linear in the size of the bucket.
3. Components of these links are formed, and only pairs of a bucket that lie in different
   components are verified further. Any link left out joins what is joined already. Buckets
   of more than `BLOCK_NODES` nodes are cut into blocks, and pairs of blocks are dealt out.

Sketches also spare pairs whose bits differ more than a linked pair's do but for one in a
million. Bands and the bound on bits follow from the similarity that a link asks (percent).
Buckets, leaders, labels and nodes that hold many rows are dealt over many tasks (spread).

Null, empty and blank texts have no words and are linked with nothing. Null ids form
their own rows with a null component id where no member has an id; repeated rows are
copies; ties between leaders go to the least node; extra columns, whatever their names, play
no part and are kept by keep_documents(); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import discard, durable, sweep
from graphloom.llm import exchange
from graphloom.llm.common import WORD, rows, small, word_bytes
from graphloom.llm.components import components
from graphloom.llm.spread import hot_keys, spread_join

WORDS = 5
PERCENT = 85
COORDINATES = 192
SEED = 0x51D
#: Linked pairs that bands may miss, and that the bound on bits may miss, at the least similarity.
MISSED = 1e-6
MISSED_BY_BITS = 1e-6
BLOCK_BYTES = 4 << 20
KNOWN_WORDS = 400_000
#: Nodes of a block of a bucket whose pairs are listed.
BLOCK_NODES = 256

_T = COORDINATES
_MASK = np.uint64((1 << 40) - 1)
_rng = np.random.default_rng(SEED)
_ROUND = _rng.integers(1, 1 << 63, 2 * _T, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, _T, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], known: dict) -> np.ndarray:
    """The set of a document: sorted hashes of its distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(mixed(total))


def sketch(elements: np.ndarray) -> np.ndarray:
    """t coordinates of a set that is not empty."""
    bins = np.full(_T, np.iinfo(np.uint64).max, np.uint64)
    first = min(_T, max(1, int(_T * (np.log(_T) + 3) / len(elements)) + 1))
    for begin in range(0, _T, first):
        turns = np.arange(begin, min(_T, begin + first), dtype=np.uint64)
        h = mixed(elements[None, :] ^ _ROUND[turns][:, None])
        np.minimum.at(bins, ((h >> np.uint64(40)) % np.uint64(_T)).ravel().astype(np.int64), ((turns << np.uint64(40))[:, None] | (h & _MASK)).ravel())
        if bins.max() != np.iinfo(np.uint64).max:
            return bins
    for i in np.flatnonzero(bins == np.iinfo(np.uint64).max):
        bins[i] = np.uint64((_T + i) << 40) | (mixed(elements ^ _ROUND[_T + i]) & _MASK).min()
    return bins


def band_rows(percent: int) -> int:
    """Coordinates of a band: as many as still miss few enough linked pairs."""
    return max((r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (_T // r) <= MISSED), default=1)


def most_bits(percent: int) -> int:
    """Bits in which the sketches of a linked pair may differ: more than this many differ in few enough pairs."""
    p = (1 - percent / 100) / 2
    tail = 1.0
    for n in range(_T + 1):
        tail -= math.comb(_T, n) * p**n * (1 - p) ** (_T - n)
        if tail <= MISSED_BY_BITS:
            return n
    return _T


def band_keys(bins: np.ndarray, rows_: int) -> np.ndarray:
    """One key for each band."""
    bands = _T // rows_
    used = (bins * _BAND)[: bands * rows_].reshape(bands, rows_)
    return mixed(used.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def bits(bins: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, in three longs."""
    return np.packbits((mixed(bins) & np.uint64(1)).astype(np.uint8)).view("<i8")


def digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.astype("<u8").tobytes())


SKETCHED = "doc_id {id}, text_hash long, n_shingles long, node binary, bands array<long>, bits array<long>"


def _sketched(rows_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in small(batches):
            sets = [shingles(word_bytes(t), known) for t in batch.column("text").to_pylist()]
            bins = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([None if b is None else band_keys(b, rows_) for b in bins], pa.list_(pa.int64())), pa.array([None if b is None else bits(b) for b in bins], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", "bits"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of nodes, gathered in blocks of bounded size: one row a block."""
    known, part, n = _Words(), TaskContext.get().partitionId(), 0
    nodes: list[bytes] = []
    sets: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        every = np.concatenate(sets).astype("<u8")
        unique, count = np.unique(every, return_counts=True)
        return pa.RecordBatch.from_pydict({"block": pa.array([part << 24 | n], pa.int64()), "nodes": pa.array([b"".join(nodes)], pa.binary()), "sizes": pa.array([np.array([len(s) for s in sets], "<i8").tobytes()], pa.binary()), "elements": pa.array([every.tobytes()], pa.binary()), "keys": pa.array([unique.tobytes()], pa.binary()), "weights": pa.array([count.astype("<i8").tobytes()], pa.binary())})

    held = 0
    for node, text in rows(batches, "node", "text"):
        own = shingles(word_bytes(text), known)
        nodes.append(node)
        sets.append(own)
        held += own.nbytes
        if held >= BLOCK_BYTES:
            yield block()
            nodes, sets, n, held = [], [], n + 1, 0
    if nodes:
        yield block()


def _survivors(parts: int, percent: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "n": [], "alone": [], "elements": []}
        for nodes, sizes, elements, keys in zip(*(blocks.column(c).to_pylist() for c in ("nodes", "sizes", "elements", "keys")), strict=True):
            known, every = np.frombuffer(keys, "<u8"), np.frombuffer(elements, "<u8")
            alone = exchange.answered(known, parts, answers)[np.searchsorted(known, every)] == 1
            at = 0
            for i, size in enumerate(np.frombuffer(sizes, "<i8").tolist()):
                u = int(alone[at : at + size].sum())
                if 100 * (size - u) >= percent * size:
                    for name, value in zip(out, (nodes[16 * i : 16 * i + 16], size, u, every[at : at + size].tobytes()), strict=True):
                        out[name].append(value)
                at += size
        return pa.table({"node": pa.array(out["node"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "alone": pa.array(out["alone"], pa.int64()), "elements": pa.array(out["elements"], pa.binary())})

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets are as similar as a link asks, on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. pairs: written. The end with more pairs brings its set last, to many tasks."""
    each = [pairs.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n")) for c in ("a", "b")]
    ends = durable(each[0].unionAll(each[1]).groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > 1), "pair-ends")
    hot = hot_keys(ends, "node", "n", 2 * pairs.count())
    busy = F.broadcast(ends.join(F.broadcast(hot), "node", "left_semi"))
    turned = pairs.join(busy.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a", "left").join(busy.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b", "left")
    turn = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    turned = turned.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    for c, by in (("b", "a"), ("a", "b")):
        turned = spread_join(turned, sets.select(F.col("node").alias(c), F.col("elements").alias(f"set_{c}")), c, by, hot.select(F.col("node").alias(c)))
    found = durable(turned.select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a binary, b binary"), "near-links")
    discard(ends)
    return found


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds by set sizes and unshared shingles, and by the bits of the sketches."""
    c = lambda side, name: F.col(f"{side}_{name}")
    shared = F.least(c(x, "n") - c(x, "alone"), c(y, "n") - c(y, "alone"))
    differ = sum((F.bit_count(F.get(c(x, "bits"), F.lit(i)).bitwiseXOR(F.get(c(y, "bits"), F.lit(i)))) for i in range(3)), F.lit(0))
    return (100 * shared >= percent * (c(x, "n") + c(y, "n") - shared)) & (differ <= most_bits(percent))


def labelled(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles and label, the component's name, of every document."""
    spark = docs.sparkSession
    sweep(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = durable(docs.mapInArrow(_sketched(band_rows(percent)), SKETCHED.format(id=kind)), "near-sketches")

    # a node is found again by the id and text hash of one of its documents
    nodes = durable(sketched.filter("n_shingles > 0").groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("copies")), "near-nodes")
    members = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    crowded = durable(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-crowded")
    wide = durable(hot_keys(crowded, "band", "n", crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "near-wide")
    members = durable(spread_join(members, crowded.select("band"), "band", "node", wide), "near-buckets")

    wanted = members.select("node").distinct().join(nodes.select("node", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("text_hash")), "node")
    texts = docs.join(wanted, (docs["text_hash"] == wanted["text_hash"]) & docs["doc_id"].eqNullSafe(wanted["_id"])).select("node", "text")
    sets = durable(texts.mapInArrow(_blocks, "block long, nodes binary, sizes binary, elements binary, keys binary, weights binary"), "near-sets")
    size = int(sets.agg(F.coalesce(F.sum(F.octet_length("elements")), F.lit(0))).first()[0])
    parts = exchange.parts_for(spark, size)
    answers = exchange.totals(sets, parts)
    alive = durable(sets.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_survivors(parts, percent), "node binary, n long, alone long, elements binary").dropDuplicates(["node"]), "near-survivors")

    facts = alive.select("node", "n", "alone").join(nodes.select("node", "bits"), "node")
    buckets, members = members, durable(members.join(facts, "node"), "near-members")
    discard(buckets, sets, crowded)
    sweep(spark)
    lead = members.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "n", "alone", "bits")).alias("lead")).filter("_n > 1")
    columns = ("node", "n", "alone", "bits")
    lead = lead.select("band", *[F.col(f"lead.{k}").alias("a" if k == "node" else f"a_{k}") for k in columns])
    led = spread_join(members.withColumnsRenamed({k: "b" if k == "node" else f"b_{k}" for k in columns}), lead, "band", "b", wide)
    led = led.filter((F.col("a") != F.col("b")) & _may_link("a", "b", percent))
    pairs = durable(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    links = _links(pairs, alive, percent)

    labels = components(links)
    labelled = durable(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
    mixed_up = labelled.groupBy("band").agg(F.min("label").alias("_least"), F.max("label").alias("_most"), F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("blocks")).filter("_least <> _most").select("band", "blocks")
    open_ = durable(spread_join(labelled, mixed_up, "band", "node", wide).join(nodes.select("node", "bands"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-open")
    discard(members, labelled)
    side = lambda s, one, two: open_.select("band", "own", one.alias("one"), two.alias("two"), *[F.col(k).alias(f"{s}_{k}") for k in ("node", "label", "place", "n", "alone", "bits", "bands")]).drop("own")
    # blocks one and two of a bucket meet once, in a task of their own
    x = side("x", F.col("own"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    y = side("y", F.explode(F.sequence(F.lit(0), F.col("own"))), F.col("own"))
    # a pair is met once, in the first band that it shares
    earlier = lambda s: F.slice(f"{s}_bands", F.lit(1), F.col("x_place"))
    first = ~F.exists(F.zip_with(earlier("x"), earlier("y"), lambda a, b: a == b), lambda same: same)
    across = x.join(y, ["band", "one", "two"]).filter(((F.col("one") < F.col("two")) | (F.col("x_node") < F.col("y_node"))) & (F.col("x_label") != F.col("y_label")) & _may_link("x", "y", percent) & first)
    rest = durable(across.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).join(pairs, ["a", "b"], "left_anti"), "near-rest")
    more = _links(rest, alive, percent)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    discard(open_, rest, pairs, links, more, alive)

    sweep(spark)
    copied = hot_keys(nodes, "node", "copies", sketched.count())
    named = spread_join(sketched.select("doc_id", "text_hash", "n_shingles", "node"), labels, "node", "doc_id", copied, "left")
    return durable(named.withColumn("label", F.coalesce("label", "node")).drop("node"), "near-documents")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    named = labelled(docs)
    least = durable(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-least")
    found = spread_join(named, least.drop("n"), "label", "doc_id", hot_keys(least, "label", "n", named.count()), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that of least id, with all columns; those without words all stay.

    Of rows with the same id and text one stays, whatever their other columns hold.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), (F.col("text").isNull() | ~F.col("text").rlike(WORD)).alias("blank"))
    first = labelled(docs, percent).filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    first = first.select(F.col("one.doc_id").alias("first_id"), F.col("one.text_hash").alias("first_hash"))
    chosen = packed.filter(~F.col("blank")).join(first, (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    copies = Window.partitionBy("doc_id", "text_hash").orderBy("text_hash")
    one = chosen.withColumn("copy", F.row_number().over(copies)).filter("copy = 1")
    return one.select("row").unionByName(packed.filter("blank").select("row")).select("row.*")
