"""Class-based n-gram scoring: exchange clustering, class transitions, word emissions.

Tokens are a text's words, A-Z lower-cased, and one end per text. A model is learnt from
the texts of the training fold and gives each text the log10 probability of its tokens:

    P(w | v) = (1 - new(v)) * P(class(w) | class(v)) * count(w) / count(class(w))   if w was seen
    P(w | v) = new(v) / unseen                                                      if not

where `unseen` estimates how many words there are that training never met, from those that it
met once and twice. So the probabilities of all seen words and of that many others add up to 1.

Every training word is clustered by exchange. First the words whose share is at least `SHARE`
(so at most 1 / SHARE words) settle among themselves: each moves to the class that raises the
likelihood of the class bigrams most, half of the words in each round. Then every other word,
down to those seen once, moves in the same way, `DEALS` times, on counts of the classes beside
it over the whole corpus; until then it stands in a fixed class by its last letters. The end
is a class of its own and stands before every first word. Transitions are smoothed towards
class frequencies. new(v) is the share of words seen once among those after v's class, and
what follows an unseen word is learnt from what follows words seen once.

Counts and classes of words are kept in parts by key and looked up in bulk by blocks of
texts, and counts are summed by Spark before they travel; only tables bounded by 1 / SHARE and
by the number of classes reach the driver or all tasks.

Null and empty texts hold only their end. Null ids train (their id is empty text). Repeated
rows count and score as they come; ties between classes go to the first; extra columns,
whatever their names, play no part; without training texts every word is unseen; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import discard, durable, sweep
from graphloom.llm import exchange
from graphloom.llm.common import id_crc, small, word_bytes

FOLDS, HELD_OUT = 7, 2
SHARE = 5e-5
DEALS = 2
CLASSES = 64
SHAPES = 16
ROUNDS = 8
SMOOTH = 20.0
BLOCK_BYTES = 8 << 20
PAIR_TOKENS = 4 << 20
#: Counts up to this come from a table of gains.
SMALL = 24
#: Words of a part whose moves are weighed at once.
CHUNK = 1_024

_SHAPE = np.uint64(SHAPES - 1)


def word_key(word: bytes) -> int:
    """A hash of the word whose low bits are its shape, taken from its last two bytes."""
    return xxhash.xxh3_64_intdigest(word) & ~(SHAPES - 1) | (word[-1] + 31 * (word[-2] if len(word) > 1 else 7)) % SHAPES


def held_out(doc_id: object) -> bool:
    return id_crc(doc_id) % FOLDS == HELD_OUT


CODED = "block long, ids array<{id}>, lengths binary, train binary, codes binary, keys binary, weights binary, tokens long, docs long"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as places of their words among the block's keys, with the words' training counts."""
    part, n, size, kind = TaskContext.get().partitionId(), 0, 0, None
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    ids: list = []
    codes: list[np.ndarray] = []
    train: list[bool] = []

    def close() -> pa.RecordBatch:
        keys, where = np.unique(np.fromiter(map(word_key, words), np.uint64, len(words)), return_inverse=True)
        every = where[np.concatenate([np.zeros(0, np.int32), *codes])].astype("<u4")
        lengths = np.array([len(c) for c in codes], "<i4")
        trains = np.array(train, bool)
        weights = np.bincount(every[np.repeat(trains, lengths)], minlength=len(keys)).astype("<i8")
        # low halves, then high halves, which are zero but for few words
        packed = np.concatenate([every & 0xFFFF, every >> 16]).astype("<u2")
        blobs = {"lengths": lengths, "train": trains, "codes": packed, "keys": keys.astype("<u8"), "weights": weights}
        row = {"block": pa.array([part << 24 | n], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()}}
        row |= {"tokens": pa.array([int((lengths[trains] + 1).sum())], pa.int64()), "docs": pa.array([int(trains.sum())], pa.int64())}
        return pa.RecordBatch.from_pydict(row)

    for batch in small(batches):
        kind = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = word_bytes(text)
            ids.append(doc_id)
            codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            train.append(not held_out(doc_id))
            size += len(text or "")
            if size >= BLOCK_BYTES:
                yield close()
                n, size, ids, codes, train = n + 1, 0, [], [], []
                words.clear()
    if ids:
        yield close()


def _laid(lengths: np.ndarray, codes: np.ndarray, ending: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with an ending after each, and where the endings are."""
    is_end = np.zeros(len(codes) + len(lengths), bool)
    is_end[np.cumsum(lengths + 1) - 1] = True
    out = np.full(len(is_end), ending, np.int64)
    out[~is_end] = codes
    return out, is_end


class _Block:
    """A coded block: keys, and places of the tokens of its texts, each text closed by place len(keys)."""

    def __init__(self, row: dict) -> None:
        self.keys = np.frombuffer(row["keys"], "<u8")
        self.lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.train = np.frombuffer(row["train"], bool)
        halves = np.frombuffer(row["codes"], "<u2").astype(np.int64).reshape(2, -1)
        self.at, self.is_end = _laid(self.lengths, halves[0] | halves[1] << 16, len(self.keys))
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)

    def training(self) -> np.ndarray:
        """Places of the training texts, after a first end."""
        return np.concatenate([[len(self.keys)], self.at[self.train[self.text]]])


@dataclass
class Vocabulary:
    """Sorted keys and counts of the first words; tokens, by shape, and number of the later ones; words met once, twice."""

    keys: np.ndarray
    counts: np.ndarray
    shape_tokens: np.ndarray
    later_words: int
    once: int
    twice: int
    often: float
    tokens: int
    docs: int

    @property
    def distinct(self) -> int:
        return len(self.keys) + self.later_words + (self.docs > 0)

    @property
    def unseen(self) -> float:
        """How many words training has not met, after Chao: the more words it met but once, the more there are."""
        return max(self.once * (self.once - 1) / (2 * (self.twice + 1)), self.once, 1.0)

    @property
    def symbols(self) -> int:
        """First words, then shapes, then the end."""
        return len(self.keys) + SHAPES + 1

    def symbol(self, keys: np.ndarray) -> np.ndarray:
        """The place among the first words, or the shape after them, of each key; the end at last."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        first = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.append(np.where(first, place, len(self.keys) + (keys & _SHAPE).astype(np.int64)), self.symbols - 1)


def _part_stats(often: float):
    """Of a part of words: tokens of later words by shape, their number, those met once and twice, and the first words."""

    def stats(keys: np.ndarray, total: np.ndarray) -> bytes:
        first = total >= often
        later = (total > 0) & ~first
        by = np.bincount((keys & _SHAPE).astype(np.int64)[later], weights=total[later], minlength=SHAPES).astype("<i8")
        return b"".join(x.tobytes() for x in (by, np.array([later.sum(), (total == 1).sum(), (total == 2).sum()], "<i8"), keys[first].astype("<u8"), total[first].astype("<i8")))

    return stats


FIRST = SHAPES + 3


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of parts as rows: what (a shape, the number of words, a first word), key and n."""
    heads = np.zeros(FIRST, np.int64)
    for blob in (b for batch in batches for b in batch.column("totals").to_pylist()):
        heads += np.frombuffer(blob[: 8 * FIRST], "<i8")
        rest = blob[8 * FIRST :]
        keys, counts = np.frombuffer(rest[: len(rest) // 2], "<i8"), np.frombuffer(rest[len(rest) // 2 :], "<i8")
        yield pa.RecordBatch.from_pydict({"what": pa.array(np.full(len(keys), FIRST)), "key": pa.array(keys), "n": pa.array(counts)})
    yield pa.RecordBatch.from_pydict({"what": pa.array(np.arange(FIRST)), "key": pa.array(np.zeros(FIRST, np.int64)), "n": pa.array(heads)})


def _vocabulary(answers: DataFrame, often: float, tokens: int, docs: int) -> Vocabulary:
    found = answers.filter(F.col("block") == exchange.STATS).select("totals").mapInArrow(_listed, "what long, key long, n long")
    rows = found.groupBy("what", "key").agg(F.sum("n").alias("n")).collect()
    heads = np.zeros(FIRST, np.int64)
    for r in rows:
        if r["what"] < FIRST:
            heads[r["what"]] = r["n"]
    first = [(r["key"], r["n"]) for r in rows if r["what"] == FIRST]
    keys, counts = (np.array([x[i] for x in first], np.int64) for i in (0, 1))
    order = np.argsort(keys.view(np.uint64))
    return Vocabulary(keys.view(np.uint64)[order], counts[order], heads[:SHAPES], *map(int, heads[SHAPES:]), often, tokens, docs)


def _summed(found: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums by cell of the tables in a column; Spark sums what tasks add up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(column).to_pylist():
                total += np.frombuffer(blob, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at), "n": pa.array(total[at])})

    rows = found.filter(F.col(column).isNotNull()).select(column).mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    out[[r["cell"] for r in rows]] = [r["n"] for r in rows]
    return out


def _pairs(vocabulary):
    """Counts of adjacent symbols: the first, the second and how often, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        n = v.symbols
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        tokens = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            both, where = np.unique(np.concatenate([code, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, where, np.concatenate([count, times]))
            return both, total

        for row in (r for batch in batches for r in batch.to_pylist()):
            block = _Block(row)
            s = v.symbol(block.keys)[block.training()]
            held.append(s[:-1] * n + s[1:])
            tokens += len(s)
            if tokens >= PAIR_TOKENS:
                code, count = merge()
                held, tokens = [], 0
        code, count = merge()
        for begin in range(0, len(code), 1 << 18):
            own, times = code[begin : begin + (1 << 18)], count[begin : begin + (1 << 18)]
            yield pa.RecordBatch.from_pydict({"word": pa.array((own // n).astype(np.int32)), "other": pa.array((own % n).astype(np.int32)), "n": pa.array(times)})

    return run


#: Bits of a symbol, and of the side, in a packed count.
SYMBOL_BITS = 16


def _beside(pairs: DataFrame) -> DataFrame:
    """One row for each symbol: packed, what follows it (side 0) and what precedes it (side 1), with counts."""
    summed = pairs.groupBy("word", "other").agg(F.sum("n").alias("n"))
    pack = lambda other, side: F.shiftleft(F.col("n"), SYMBOL_BITS + 1).bitwiseOR(F.shiftleft(F.col(other).cast("long"), 1)).bitwiseOR(F.lit(side))
    sides = F.explode(F.array(F.struct(F.col("word").alias("of"), pack("other", 0).alias("p")), F.struct(F.col("other").alias("of"), pack("word", 1).alias("p"))))
    return summed.select(sides.alias("s")).select(F.col("s.of").alias("word"), F.col("s.p").alias("p")).groupBy("word").agg(F.collect_list("p").alias("packed"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_move(right: np.ndarray, left: np.ndarray, own: float, total: float, home: int, matrix: np.ndarray, sums: np.ndarray, classes: int) -> tuple[int, float]:
    """The class to which a word should move and the gain in log likelihood.

    right[c], left[c]: bigrams of the word with class c after and before it; own: with
    itself; total: the word's count; matrix: class bigrams; sums: class counts.
    """
    m, r, l = matrix.copy(), right.copy(), left.copy()
    r[home] -= own
    l[home] -= own
    m[home] -= r
    m[:, home] -= l
    m[home, home] -= own
    s = sums.copy()
    s[home] -= total
    rows_, columns = _xlogx(m + r[None, :]) - _xlogx(m), _xlogx(m + l[:, None]) - _xlogx(m)
    diagonal = np.arange(len(m))
    corner = _xlogx(m[diagonal, diagonal] + r + l + own) - _xlogx(m[diagonal, diagonal])
    gain = rows_.sum(1) - rows_[diagonal, diagonal] + columns.sum(0) - columns[diagonal, diagonal] + corner - 2 * (_xlogx(s + total) - _xlogx(s))
    to = int(np.argmax(gain[:classes]))
    return to, float(gain[to] - gain[home])


def likelihood(matrix: np.ndarray, sums: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - 2 * _xlogx(sums).sum())


def _round(state):
    """The class bigrams that the symbols begin, by cell, or the best moves of the words whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, matrix, sums, counts, movable, most, turn = state.value
        c = len(sums)
        here = np.zeros((c, c))
        for batch in small(batches, 64):
            words = batch.column("word").to_numpy()
            lists = batch.column("packed")
            row = np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            packed = lists.flatten().to_numpy(zero_copy_only=False)
            after, other, n = packed & 1 == 0, packed >> 1 & (1 << SYMBOL_BITS) - 1, packed >> SYMBOL_BITS + 1
            right, left = (np.bincount(row[m] * c + classes[other[m]], weights=n[m], minlength=len(words) * c).reshape(-1, c) for m in (after, ~after))
            if matrix is None:
                np.add.at(here, classes[words], right)
                continue
            own = np.bincount(row[same := after & (other == words[row])], weights=n[same], minlength=len(words))
            moves = []
            for i, word in enumerate(words.tolist()):
                if word < movable and (word + turn) % 2 == 0:
                    to, gain = best_move(right[i], left[i], own[i], counts[word], int(classes[word]), matrix, sums, most)
                    if gain > 1e-6:
                        moves.append((word, to))
            yield pa.RecordBatch.from_pydict({"key": pa.array([w for w, _ in moves], pa.int64()), "n": pa.array([to for _, to in moves], pa.int64())})
        if matrix is None:
            at = np.flatnonzero(here)
            yield pa.RecordBatch.from_pydict({"key": pa.array(at), "n": pa.array(here.ravel()[at].astype(np.int64))})

    return run


def cluster(beside: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, most: int = CLASSES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all symbols and class bigrams by exchange, and the likelihood at each round.

    A round counts the class bigrams of the present classes and then weighs moves on them.
    Words move side by side, so a round can lose; the best classes seen are returned.
    """
    context = beside.sparkSession.sparkContext
    k = len(vocabulary.keys)
    rank = np.empty(k, np.int64)
    rank[np.lexsort((vocabulary.keys, -vocabulary.counts))] = np.arange(k)
    classes = np.concatenate([rank % most, most + np.arange(SHAPES + 1)])
    counts = np.concatenate([vocabulary.counts, vocabulary.shape_tokens, [vocabulary.docs]]).astype(float)
    c, best, seen = most + SHAPES + 1, None, []

    def pass_(matrix: np.ndarray | None, turn: int) -> DataFrame:
        return beside.mapInArrow(_round(context.broadcast((classes, matrix, sums, counts, k, most, turn))), "key long, n long")

    for turn in range(rounds + 1):
        sums = np.bincount(classes, weights=counts, minlength=c)
        found = pass_(None, turn).groupBy("key").agg(F.sum("n").alias("n")).collect()
        matrix = np.zeros(c * c)
        matrix[[r["key"] for r in found]] = [r["n"] for r in found]
        matrix = matrix.reshape(c, c)
        level = likelihood(matrix, sums)
        seen.append(level)
        if best is None or level > best[0]:
            best = (level, classes, matrix)
        if turn < rounds:
            moves = pass_(matrix, turn).collect()
            classes = classes.copy()
            classes[[r["key"] for r in moves]] = [r["n"] for r in moves]
    return best[1], best[2], seen


BESIDES = "part long, block long, keys binary, home binary, times binary, before binary, after binary, again binary, bigrams binary"
TEXTS = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, known double, classes binary, bigrams binary"


def _arrow(fields: str, kind: pa.DataType | None = None) -> pa.Schema:
    of = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "{id}": kind}
    return pa.schema([(name, of[t]) for name, t in map(str.split, fields.split(", "))])


def _read(answers: pa.Table, column: str, kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """What the parts say of a block's keys, in the order of the keys."""
    own = answers.filter(pc.is_valid(answers.column(column)))
    out, p = np.zeros(len(keys), kind), exchange.part_of(keys, parts)
    order = np.argsort(p, kind="stable")
    edges = np.searchsorted(p[order], np.arange(parts + 1))
    for part, blob in zip(own.column("part").to_pylist(), own.column(column).to_pylist(), strict=True):
        out[order[edges[part] : edges[part + 1]]] = np.frombuffer(blob, kind)
    return out


def _known(block: _Block, v: Vocabulary, first: np.ndarray, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, class and whether it is a later word of each key of a block; the end's class at last."""
    count = _read(answers, "totals", "<i8", block.keys, parts)
    later = (count > 0) & (count < v.often)
    classes = first[v.symbol(block.keys)]
    if answers.column("classes").null_count < len(answers):
        classes[:-1][later] = _read(answers, "classes", "u1", block.keys[later], parts)
    return count, classes, later


def _bigrams(classes: np.ndarray, once: np.ndarray, c: int) -> bytes:
    """Class bigrams, with a last row and column for what follows and what precedes words seen once."""
    n = c + 1
    a, b, once_a, once_b = classes[:-1], classes[1:], once[:-1], once[1:]
    cells = [a * n + b, a[once_b] * n + c, c * n + b[once_a], np.full(int((once_a & once_b).sum()), c * n + c)]
    return np.bincount(np.concatenate(cells), minlength=n * n).astype("<i8").tobytes()


def _gather(state, parts: int):
    """Of each block its class bigrams, and to each part the later words with the classes beside them."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        v, first, c = state.value
        out = [_arrow(BESIDES).empty_table()]
        for row in coded.to_pylist():
            block = _Block(row)
            count, classes, later = _known(block, v, first, answers, parts)
            t = block.training()
            beside = classes[t]
            keys = block.keys[later]
            p = exchange.part_of(keys, parts)
            order = np.argsort(p, kind="stable")
            # words in the order in which they are sent, and their tokens in that order
            rank = np.full(len(block.keys) + 1, -1)
            rank[np.flatnonzero(later)[order]] = np.arange(len(keys))
            at = np.flatnonzero(rank[t] >= 0)
            at = at[np.argsort(rank[t[at]], kind="stable")]
            times = np.bincount(rank[t[at]], minlength=len(keys))
            words = np.searchsorted(p[order], np.arange(parts + 1))
            tokens = np.concatenate([[0], np.cumsum(times)])[words]
            own = [i for i in range(parts) if words[i] < words[i + 1]]
            cut = lambda a, edges, kind: [a[edges[i] : edges[i + 1]].astype(kind).tobytes() for i in own]  # noqa: E731, B023
            sent = {"part": own, "block": [row["block"]] * len(own)}
            for name, a, kind in (("keys", keys[order], "<u8"), ("home", classes[:-1][later][order], "u1"), ("times", times, "<i4")):
                sent[name] = cut(a, words, kind)
            for name, a, kind in (("before", beside[at - 1], "u1"), ("after", beside[np.minimum(at + 1, len(t) - 1)], "u1"), ("again", t[np.minimum(at + 1, len(t) - 1)] == t[at], "u1")):
                sent[name] = cut(a, tokens, kind)
            out.append(pa.table({**sent, "bigrams": [None] * len(own)}, schema=_arrow(BESIDES)))
            out.append(pa.Table.from_pylist([{"block": row["block"], "bigrams": _bigrams(beside, np.append(count == 1, False)[t], c)}], schema=_arrow(BESIDES)))
        return pa.concat_tables(out)

    return run


class Gains:
    """What class bigrams gain by words that join a class, each class to go to a column."""

    def __init__(self, matrix: np.ndarray, sums: np.ndarray, most: int) -> None:
        self.matrix, self.sums, self.most = matrix, sums, most
        n = np.arange(SMALL + 1)[:, None, None]
        # by a count, a neighbour's class and the class to go to: after the word, and before it
        self.sides = (matrix[:most].T, matrix[:, :most])
        self.tables = tuple((_xlogx(side[None] + n) - _xlogx(side)[None]).astype(np.float32) for side in self.sides)

    def best(self, right: np.ndarray, left: np.ndarray, own: np.ndarray, total: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The best class for each word (a row of right and left: its bigrams with each class).

        A word first leaves its home's row, column and count; that its leaving also changes
        the cells between its home and the other classes, where it stands beside words of its
        home, is left out of account.
        """
        most, n = self.most, np.arange(len(home))
        r, l = right.copy(), left.copy()
        r[n, home] -= own
        l[n, home] -= own
        gain = np.zeros((len(home), most))
        inside = home < most
        for mine, side, table in ((r, self.sides[0], self.tables[0]), (l, self.sides[1], self.tables[1])):
            word, beside = np.nonzero(mine)
            if not len(word):
                continue
            times = mine[word, beside]
            few = times <= SMALL
            each = table[np.minimum(times, SMALL), beside].astype(float)
            each[~few] = _xlogx(side[beside[~few]] + times[~few, None]) - _xlogx(side[beside[~few]])
            stay = np.flatnonzero(inside[word])
            here = side[beside[stay], home[word[stay]]]
            each[stay, home[word[stay]]] = _xlogx(here) - _xlogx(np.maximum(here - times[stay], 0))
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[begins]] += np.add.reduceat(each, begins)
        # where a word meets the class itself, both sides and the word's own bigrams change one cell
        diagonal = np.broadcast_to(self.matrix[np.arange(most), np.arange(most)], gain.shape).copy()
        word = np.flatnonzero(inside)
        diagonal[word, home[word]] = np.maximum(diagonal[word, home[word]] - (r[word, home[word]] + l[word, home[word]] + own[word]), 0)
        i, k = np.nonzero((r[:, :most] > 0) & (l[:, :most] > 0) | (own > 0)[:, None])
        d, a, b, o = diagonal[i, k], r[i, k], l[i, k], own[i]
        gain[i, k] += _xlogx(d + a + b + o) + _xlogx(d) - _xlogx(d + a) - _xlogx(d + b)
        s = np.broadcast_to(self.sums[:most], gain.shape).copy()
        s[word, home[word]] = np.maximum(s[word, home[word]] - total[word], 0)
        gain -= 2 * (_xlogx(s + total[:, None]) - _xlogx(s))
        to = gain.argmax(1)
        # empty classes are alike: words go to one of them by the classes most often beside them
        empty = np.flatnonzero(self.sums[:most] == 0)
        if len(empty):
            lone = self.sums[to] == 0
            to[lone] = empty[((l.argmax(1) * 31 + r.argmax(1)) % len(empty))[lone]]
        return to


def _deal(state):
    """The class of each later word of a part, for every block in the order in which it sent them."""

    def run(group: pa.Table) -> pa.Table:
        matrix, sums, most = state.value
        c, gains = len(sums), Gains(matrix, sums, most)
        column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])
        lengths = [len(k) // 8 for k in group.column("keys").to_pylist()]
        unique, one, where = np.unique(column("keys", "<u8"), return_index=True, return_inverse=True)
        home = column("home", "u1")[one].astype(np.int64)
        word = np.repeat(where, column("times", "<i4"))
        count = np.bincount(word, minlength=len(unique))
        order = np.argsort(word, kind="stable")
        word = word[order]
        before, after, again = (column(name, "u1")[order] for name in ("before", "after", "again"))
        new = np.empty(len(unique), "u1")
        for begin in range(0, len(unique), CHUNK):
            own = slice(*np.searchsorted(word, [begin, begin + CHUNK]))
            n = min(CHUNK, len(unique) - begin)
            w = word[own] - begin
            beside = lambda x: np.bincount(w * c + x[own], minlength=n * c).reshape(n, c)  # noqa: E731, B023
            new[begin : begin + n] = gains.best(beside(after), beside(before), np.bincount(w, weights=again[own], minlength=n).astype(np.int64), count[begin : begin + n], home[begin : begin + n])
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        return pa.table({"block": group.column("block"), "part": group.column("part"), "classes": pa.array([new[where[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def _texts(state, parts: int):
    """Each text with its base score, its words' logs and classes; of each block its class bigrams.

    The log of a seen word is that of its count, of an unseen one 0; the class of an unseen
    word is c.
    """

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        v, first, c = state.value
        schema = _arrow(TEXTS, coded.schema.field("ids").type.value_type)
        out = [schema.empty_table()]
        for row in coded.to_pylist():
            block = _Block(row)
            count, classes, _ = _known(block, v, first, answers, parts)
            t = block.training()
            seen = np.append(count > 0, True)
            told = np.where(seen, classes, c)
            counts = np.append(count, v.docs)
            logs = np.where(seen, np.log10(np.maximum(counts, 1)), 0.0)
            logs[-1] = 0.0
            n = len(block.lengths)
            total = lambda x: np.bincount(block.text, weights=x[block.at], minlength=n)  # noqa: E731, B023
            codes = told[block.at].astype("u1")
            begins = np.concatenate([[0], np.cumsum(block.lengths + 1)])
            out.append(pa.table({"doc_id": row["ids"], "held_out": ~block.train, "n_tokens": block.lengths + 1, "n_known": total((counts > 0).astype(float)).astype(np.int64), "base_score": total(np.log10((counts + 1) / (v.tokens + v.distinct + 1))), "known": total(logs), "classes": [codes[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], "bigrams": pa.nulls(n, pa.binary())}, schema=schema))
            out.append(pa.Table.from_pylist([{"bigrams": _bigrams(classes[t], np.append(count == 1, False)[t], c)}], schema=schema))
        return pa.concat_tables(out)

    return run


@dataclass
class Model:
    """log10 of a step from a class (or c, an unseen word) to a word of a class but for the word's own log.

    steps[a, b]: from a to b, down to the share of one token of b; steps[a, c]: to an unseen
    word. likelihoods: of the class bigrams, round by round.
    """

    vocabulary: Vocabulary
    steps: np.ndarray
    sums: np.ndarray
    likelihoods: list[float]


def model_of(vocabulary: Vocabulary, bigrams: np.ndarray, likelihoods: list[float]) -> Model:
    """The model from class bigrams with the row and column of words seen once (c by c, plus one)."""
    c = len(bigrams) - 1
    counts, once = bigrams[:, :c], bigrams[:, c]
    sums = counts[:c].sum(0)
    unigram = (sums + 1) / (sums.sum() + c)
    after = counts.sum(1)
    share = (once[:c].sum() + 0.5) / (sums.sum() + 1)
    new = (once + SMOOTH * share) / (after + SMOOTH)
    transitions = (counts + SMOOTH * unigram) / (after[:, None] + SMOOTH)
    token = np.maximum(sums, 1)
    token[-1] = 1  # the end is the only word of its class
    return Model(vocabulary, np.log10(np.hstack([(1 - new[:, None]) * transitions / token, new[:, None] / vocabulary.unseen])), sums, likelihoods)


def fit(coded: DataFrame, rounds: int = ROUNDS, most: int = CLASSES, deals: int = DEALS) -> tuple[Model, DataFrame, int]:
    """The model, the texts with their classes, and the parts of the words. coded: what _coded() gives, written."""
    spark = coded.sparkSession
    kind = coded.schema["ids"].dataType.elementType.simpleString()
    tokens, docs, size, blocks = coded.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("tokens"), F.col("docs"), F.octet_length("keys"))], F.count(F.lit(1))).first()
    parts = exchange.parts_for(spark, int(size))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(blocks) // 4)
    often = max(2.0, SHARE * tokens)
    answers = durable(exchange.totals(coded, parts, _part_stats(often)), "word-totals")
    v = _vocabulary(answers, often, int(tokens), int(docs))
    shared = spark.sparkContext.broadcast(v)
    sweep(spark)
    texts = coded.select("block", "ids", "lengths", "train", "codes", "keys")
    beside = durable(_beside(texts.select("lengths", "train", "codes", "keys").mapInArrow(_pairs(shared), "word int, other int, n long")), "word-pairs")
    classes, matrix, seen = cluster(beside, v, rounds, most)
    discard(beside)
    sweep(spark)
    c = len(matrix)
    state = spark.sparkContext.broadcast((v, classes, c))
    known = answers.filter(F.col("block") != exchange.STATS).withColumn("classes", F.lit(None).cast("binary"))

    def by_block(run, dealt: DataFrame | None, schema: str, *columns: str) -> DataFrame:
        told_ = known if dealt is None else known.unionByName(dealt, allowMissingColumns=True)
        sides = [x.repartition(tasks, "block").groupBy("block") for x in (texts.select("block", *columns), told_)]
        return durable(sides[0].cogroup(sides[1]).applyInArrow(run, schema), "lm-classes")

    def bigrams_of(found: DataFrame) -> np.ndarray:
        return _summed(found, "bigrams", (c + 1) ** 2).reshape(c + 1, c + 1).astype(float)

    dealt, tables = None, []
    for _ in range(deals if v.later_words else 0):
        found = by_block(_gather(state, parts), dealt, BESIDES, "lengths", "train", "codes", "keys")
        matrix = bigrams_of(found)[:c, :c]
        if dealt is not None:
            tables.append((likelihood(matrix, matrix.sum(0)), dealt))
        now = spark.sparkContext.broadcast((matrix, matrix.sum(0), most))
        dealt = durable(found.filter("part is not null").drop("bigrams").repartition(parts, "part").groupBy("part").applyInArrow(_deal(now), "block long, part long, classes binary"), "word-classes")
        discard(found)
        del found
        sweep(spark)
    final = lambda by: by_block(_texts(state, parts), by, TEXTS.format(id=kind), "ids", "lengths", "train", "codes", "keys")
    told = final(dealt)
    bigrams = bigrams_of(told)
    levels = [level for level, _ in tables]
    if dealt is not None:
        levels.append(likelihood(bigrams[:c, :c], bigrams[:c, :c].sum(0)))
    if levels and max(levels) > levels[-1]:
        # words move side by side, so a deal can lose
        discard(told)
        told = final(tables[int(np.argmax(levels[:-1]))][1])
        bigrams = bigrams_of(told)
    discard(answers, *(table for _, table in tables), *([dealt] if dealt is not None else []))
    return model_of(v, bigrams, [*seen, *levels]), told, parts


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        end = m.steps.shape[1] - 2
        for batch in batches:
            scores = []
            for known, classes in zip(batch.column("known").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                codes = np.frombuffer(classes, "u1")
                scores.append(known + m.steps[np.concatenate([[end], codes[:-1]]), codes].sum())
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([m.vocabulary.tokens] * n, pa.int64()), batch.column("base_score"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def coded_texts(docs: DataFrame) -> DataFrame:
    """The blocks of all texts, written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return durable(docs.select("doc_id", "text").mapInArrow(_coded, CODED.format(id=kind)), "lm-coded")


def score_documents(docs: DataFrame, rounds: int = ROUNDS, deals: int = DEALS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = coded_texts(docs)
    model, told, _ = fit(coded, rounds=rounds, deals=deals)
    discard(coded)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = told.filter("classes is not null").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "known", "classes")
    scored = texts.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
