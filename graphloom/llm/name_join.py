"""Edit-distance join of names by asymmetric q-chunks: one side indexes chunks, the other probes q-grams.

Distance is optimal string alignment: insertions, deletions, substitutions and exchanges of two
adjacent code points, no substring edited twice. A name on the index side of L code points is cut
into disjoint chunks of q = min(L / 5, 6). An edit spoils at most two chunks, as an exchange may
straddle their border, so of C chunks at least C - 2 * most stay whole in every name within the
distance, each shifted by no more than the insertions and deletions that the two lengths leave
room for. Five chunks are indexed, at every length and place where they may stand; the
probing side emits its q-grams with length and place once. Index names of under five code
points are met by length alone.

Names are collapsed to distinct ones before anything meets. A key that many names share is cut
into blocks on both sides, whose pairs go to tasks of their own. Within a task a pair is taken
for the first key it shares only, then by signs of 64 bits, of which an edit changes two at
most, then by the number of whole chunks, then by its distance; what leaves the task are sums per
name and distance. Nothing is broadcast or collected: all joins are asked to sort and merge.

Null and empty names take no part. Repeated rows on either side count as often as they come.
A null vendor id leaves its name as stored and forms a vendor of its own; null client ids are
counted, but add nothing to the least id and the crc sum. Extra columns, whatever their names,
play no part. Without a qualifying pair, or with an empty table, there are no rows. Long names
have longer bands of cells, and never more chunks or other keys than their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import durable

MOST = 2
#: Chunks that are indexed: one more than edits can spoil.
CHUNKS = 2 * MOST + 1
LONGEST_CHUNK = 6
#: Entries of a key that a block holds on either side; entries of a task, about; cells worked on at once.
BLOCK, PART, CELLS = 1024, 1 << 16, 1 << 22


def width(length: Column) -> Column:
    """Code points of a chunk; 0: too short for chunks."""
    return F.least(F.floor(length / CHUNKS), F.lit(LONGEST_CHUNK)).cast("int")


def misspelt(name: str, vendor_id: str) -> Column:
    """The stored name, with two adjacent code points exchanged where the crc of the id is even."""
    h, size, n = F.crc32(F.col(vendor_id).cast("string").cast("binary")), F.char_length(name), F.col(name)
    at = F.pmod(h, F.greatest(size - 1, F.lit(1))).cast("int")
    turned = F.concat(F.substring(n, F.lit(1), at), F.substring(n, at + 2, F.lit(1)), F.substring(n, at + 1, F.lit(1)), F.substring(n, at + 3, size))
    return F.when((F.pmod(h, F.lit(2)) == 0) & (size >= 2), turned).otherwise(n)


def _key(size: Column, q: Column, place: Column, gram: Column) -> Column:
    return F.xxhash64(size.cast("int"), q.cast("int"), place.cast("int"), gram)


def index_entries(names: DataFrame) -> DataFrame:
    """key, name, chunk and shift: each distinct name at every length and place where its chunks may stand."""
    size = F.char_length("name")
    moves = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(-MOST, MOST + 1) for s in range(-((MOST - d) // 2), (MOST + d) // 2 + 1)])
    cut = names.select("name", size.alias("size"), width(size).alias("q"))
    chunks = cut.filter("q > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1)))).withColumn("m", F.explode(moves))
    place, other = F.col("chunk") * F.col("q") + F.col("m.s"), F.col("size") + F.col("m.d")
    gram = F.substring(F.col("name"), F.col("chunk") * F.col("q") + 1, F.col("q"))
    long = chunks.filter((place >= 0) & (place + F.col("q") <= other)).select(_key(other, F.col("q"), place, gram).alias("key"), "name", "chunk", F.col("m.s").alias("shift"))
    short = cut.filter("q = 0").withColumn("other", F.explode(F.sequence(F.greatest(F.col("size") - MOST, F.lit(1)), F.col("size") + MOST)))
    return long.unionByName(short.select(_key(F.col("other"), F.lit(0), F.lit(0), F.lit("")).alias("key"), "name", F.lit(0).alias("chunk"), F.lit(0).alias("shift")))


def probe_entries(names: DataFrame) -> DataFrame:
    """key and all columns of names: every positional q-gram that an indexed chunk can be."""
    size = F.char_length("name")
    sizes = F.sequence(F.greatest(size - MOST, F.lit(1)), size + MOST)
    grams = names.withColumn("_q", F.explode(F.array_distinct(F.transform(sizes, width)))).withColumn("_last", F.when(F.col("_q") == 0, F.lit(0)).otherwise(F.least(size - F.col("_q"), (CHUNKS - 1) * F.col("_q") + MOST)))
    at = grams.filter("_last >= 0").withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return at.select(_key(size, F.col("_q"), F.col("_place"), F.substring(F.col("name"), F.col("_place") + 1, F.col("_q"))).alias("key"), *names.columns)


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: int = MOST) -> np.ndarray:
    """Distances of pairs of names (rows of code points, lengths at most `most` apart), most + 1 where larger."""
    n, far = len(a), np.int8(most + 1)
    b = np.pad(b, ((0, 0), (0, max(0, a.shape[1] + most - b.shape[1]))))
    out = np.full(n, far, np.int8)
    lost = np.full(n, far, np.int8)
    row = {k: np.full(n, k, np.int8) if k >= 0 else lost for k in range(-most, most + 1)}
    before: dict[int, np.ndarray] = {}
    for i in range(1, a.shape[1] + 1):
        now: dict[int, np.ndarray] = {}
        for k in range(-most, most + 1):
            j = i + k
            if j <= 0:
                now[k] = np.full(n, min(i, int(far)), np.int8) if j == 0 else lost
                continue
            best = row[k] + (a[:, i - 1] != b[:, j - 1])
            if k < most:
                best = np.minimum(best, row[k + 1] + 1)
            if k > -most:
                best = np.minimum(best, now[k - 1] + 1)
            if i > 1 and j > 1:
                turned = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(turned, np.minimum(best, before[k] + 1), best)
            now[k] = np.minimum(best, far).astype(np.int8)
        before, row = row, now
        for k in range(-most, most + 1):
            out = np.where((la == i) & (lb - la == k), row[k], out)
    return out


def _codes(names: list[str]) -> np.ndarray:
    """Code points, a row a name."""
    wide = np.array(names, dtype=np.str_)
    return wide.view(np.uint32).reshape(len(names), -1) if wide.itemsize else np.zeros((len(names), 1), np.uint32)


def _signs(names: list[str], lengths: np.ndarray) -> np.ndarray:
    """64 bits of each name, of which every code point flips one: an edit changes at most two of them."""
    out, order, at = np.zeros(len(names), np.uint64), np.argsort(lengths, kind="stable"), 0
    while at < len(names):
        stop = min(len(names), at + max(1, CELLS // (8 * int(lengths[order[at]]) + 8)))
        own = order[at : max(at + 1, np.searchsorted(lengths[order[:stop]], 2 * lengths[order[at]] + 8, "right"))]
        codes = _codes([names[i] for i in own]).astype(np.uint64)
        bits = np.uint64(1) << ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        bits[np.arange(codes.shape[1])[None, :] >= lengths[own][:, None]] = 0
        out[own] = np.bitwise_xor.reduce(bits, axis=1)
        at += len(own)
    return out


def _first_and_enough(a, la, b, lb, chunk, shift) -> np.ndarray:
    """Whether this key is the first a pair shares, and as many chunks stay whole as must."""
    q = np.minimum(la // CHUNKS, LONGEST_CHUNK)
    keep = q == 0
    for width_ in np.unique(q[q > 0]):
        own = np.flatnonzero(q == width_)
        x, y, delta = a[own], b[own], (lb - la)[own]
        cut = la[own] // width_ if width_ < LONGEST_CHUNK else np.full(len(own), CHUNKS)
        whole, first = np.zeros(len(own), np.int32), np.full(len(own), -1, np.int64)
        for i in range(int(cut.max())):
            hit = np.zeros(len(own), bool)
            for s in range(-MOST, MOST + 1):
                at = i * width_ + s
                if at < 0 or at + width_ > y.shape[1] or (i + 1) * width_ > x.shape[1]:
                    continue
                fits = (s >= -((MOST - delta) // 2)) & (s <= (MOST + delta) // 2) & (at + width_ <= lb[own]) & (i < cut)
                same = fits & (x[:, i * width_ : (i + 1) * width_] == y[:, at : at + width_]).all(axis=1)
                first = np.where(same & (first < 0), i * 16 + s + MOST, first)
                hit |= same
            whole += hit
        keep[own] = (whole >= cut - 2 * MOST) & (first == chunk[own] * 16 + shift[own] + MOST)
    return keep


def _named(side: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, and of each row: its name's place, length and sign."""
    names = side.column("name").combine_chunks().dictionary_encode()
    names, of = names.dictionary.to_pylist(), names.indices.to_numpy()
    lengths = np.array([len(x) for x in names], np.int64)
    return names, of, lengths[of], _signs(names, lengths)[of]


def _met(probes: pa.Table, index: pa.Table) -> pa.Table:
    """name, distance and the sums over probing names, of the pairs whose keys meet in this task."""
    out = {"name": [], "distance": [], "n_clients": [], "first_client_id": [], "clients_crc": []}
    pk, ik = probes.column("key").to_numpy(), index.column("key").to_numpy()
    (p_names, p_of, p_len, p_sign), (i_names, i_of, i_len, i_sign) = _named(probes), _named(index)
    order, place = np.argsort(pk, kind="stable"), np.lexsort((ik, i_len))
    begin, end = (np.searchsorted(pk[order], ik[place], side) for side in ("left", "right"))
    met = end > begin
    place, begin, end = place[met], begin[met], end[met]
    chunk, shift = index.column("chunk").to_numpy().astype(np.int64), index.column("shift").to_numpy().astype(np.int64)
    upto = np.cumsum(end - begin)
    at = 0
    while at < len(place):
        # as many entries of the index, by length, as give no more cells than are worked on at once
        wide = max(1, int(i_len[place[at]]) + MOST)
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS // wide)))
        stop = min(stop, at + max(1, int(np.argmax(i_len[place[at:stop]] > wide)) or stop - at))
        many = (end - begin)[at:stop]
        entry = np.repeat(place[at:stop], many)
        probe = order[np.repeat(begin[at:stop], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        near = np.flatnonzero(np.bitwise_count(i_sign[entry] ^ p_sign[probe]) <= 2 * MOST)
        at, entry, probe = stop, entry[near], probe[near]
        if not len(near):
            continue
        ids_i, one = np.unique(i_of[entry], return_inverse=True)
        ids_p, two = np.unique(p_of[probe], return_inverse=True)
        a, b = _codes([i_names[i] for i in ids_i]), _codes([p_names[i] for i in ids_p])
        la, lb = i_len[entry], p_len[probe]
        keep = np.flatnonzero((np.abs(la - lb) <= MOST) & _first_and_enough(a[one], la, b[two], lb, chunk[entry], shift[entry]))
        d = distances(a[one[keep]], la[keep], b[two[keep]], lb[keep])
        for k in np.flatnonzero(d <= MOST):
            i, p = int(entry[keep[k]]), int(probe[keep[k]])
            out["name"].append(i_names[i_of[i]])
            out["distance"].append(int(d[k]))
            for c in ("n_clients", "first_client_id", "clients_crc"):
                out[c].append(probes.column(c)[p].as_py())
    table = pa.table({c: pa.array(v, pa.string() if c == "name" else pa.int32() if c == "distance" else pa.int64()) for c, v in out.items()})
    summed = table.group_by(["name", "distance"]).aggregate([("n_clients", "sum"), ("first_client_id", "min"), ("clients_crc", "sum")])
    return summed.select(["name", "distance", "n_clients_sum", "first_client_id_min", "clients_crc_sum"]).rename_columns(list(out))


def name_pairs(probing: DataFrame, indexed: DataFrame) -> DataFrame:
    """name (of indexed), distance, n_clients, first_client_id and clients_crc of all qualifying pairs.

    probing: distinct names with the three sums; indexed: distinct names.
    """
    spark = probing.sparkSession
    probes, index = probe_entries(probing), index_entries(indexed)
    count = lambda df, n: df.groupBy("key").agg(F.count(F.lit(1)).alias(n))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    keys = durable(count(index, "n_index").hint("merge").join(count(probes, "n_probe"), "key").select("key", blocks("n_index").alias("ones"), blocks("n_probe").alias("twos"), "n_index", "n_probe"), "name-keys")
    entries = keys.agg(F.coalesce(F.sum(F.col("n_index") * F.col("twos") + F.col("n_probe") * F.col("ones")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // PART)
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met, part = F.xxhash64("key", "one", "two").alias("key"), F.pmod("key", F.lit(parts)).alias("part")
    left = probes.hint("merge").join(keys, "key").withColumn("two", own("twos")).withColumn("one", every("ones")).select(met, *probing.columns).select(part, "*")
    right = index.hint("merge").join(keys, "key").withColumn("one", own("ones")).withColumn("two", every("twos")).select(met, "name", "chunk", "shift").select(part, "*")
    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_met, "name string, distance int, n_clients long, first_client_id long, clients_crc long")
    return found.groupBy("name", "distance").agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))


def join_names(clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id and clients_crc, for distances with a qualifying pair."""
    sold = durable(vendors.filter("name <> ''").select("vendor_id", misspelt("name", "vendor_id").alias("name")), "name-vendors")
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    bought = clients.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n_clients"), F.min(F.col("client_id").cast("long")).alias("first_client_id"), F.sum(crc).alias("clients_crc"))
    found = name_pairs(durable(bought, "name-clients"), sold.select("name").distinct())
    return sold.hint("merge").join(found, "name").groupBy("vendor_id", "distance").agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))
