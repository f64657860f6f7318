"""Mixing sources to target weights with a low-discrepancy schedule.

Slot k of the schedule takes the point k * g mod 1 (g: the golden ratio's fraction, in
61-bit arithmetic) and the source whose interval of the cumulative weights holds it. Slots
are ranked within their source; the documents of a source, shuffled by hash, are cut into
blocks of equal word counts; and the slot of rank j takes block j, starting over after the
last block. A block has at most `BLOCK` words and a source `LEAST_BLOCKS` blocks (or one for
each word) at least, whatever the size of the corpus. Slots beyond a source's target fall
away and missing ones follow at the end, so each source comes within half a block of its
target. A document stands in the schedule where the first of its blocks does, once for each
time it is taken: mix_documents() deals its copies out in that order.

Targets share a budget of words by weight; a target stops at `most` times the words of its
source and what is left is shared again by weight. Null texts have no words, a null source
is a source of its own and comes last, repeated rows are separate documents (in mix_documents()
those equal in id, text and source are taken equally often), extra columns, whatever their
names, are kept by mix_documents() and play no part, and an empty table gives an empty result.
The result depends only on the rows, never on how they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import durable, sweep
from graphloom.llm.common import WORD
from graphloom.llm.prefix import running

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = 29
#: Words of a block at most, and blocks of a source at least.
BLOCK = 4_096
LEAST_BLOCKS = 1_024
BUCKETS = 1_024
CELL_BITS = 12
UNIT_BITS = 61
UNIT = 1 << UNIT_BITS
GOLDEN = 1_425_089_352_415_399_811  # UNIT * (sqrt(5) - 1) / 2, odd
LOW_BITS = 31


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target and s, the source's rank, from one row per source.

    Water filling in closed form: in order of most * size / weight the first sources are
    full, and the rest share what those leave.
    """
    ranked = sized.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy("_ratio", "s")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    level = ranked.withColumn("_w", weight.cast("double")).withColumn("_full", full).withColumn("_ratio", F.col("_full") / F.col("_w"))
    level = level.withColumn("_left", F.lit(budget) * F.sum("source_size").over(every) - (F.sum("_full").over(upto) - F.col("_full")))
    level = level.withColumn("_weights", F.sum("_w").over(every) - (F.sum("_w").over(upto) - F.col("_w")))
    level = level.withColumn("_level", F.min(F.when(F.col("_left") / F.col("_weights") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("s"), (F.col("_left") / F.col("_weights")).alias("x")))).over(every)["x"])
    return level.select("source", "source_size", "s", F.coalesce(F.least("_full", F.col("_level") * F.col("_w")), F.col("_full")).alias("target"))


def _intervals(plan: DataFrame) -> DataFrame:
    """lo and hi of each source on 0 to UNIT, the slots its target needs (want), and the slots in all."""
    slots = F.col("target") / (F.col("source_size") / F.col("blocks"))
    order = Window.orderBy("s")
    every = Window.partitionBy()
    cut = plan.filter(F.col("source_size") > 0).withColumn("_slots", slots).withColumn("_to", F.sum("_slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("_slots").over(every))
    # each begins where the one before it ends, and the last ends at UNIT
    end = F.when(F.lead("s").over(order).isNull(), F.lit(UNIT)).otherwise(F.least(F.round(F.col("_to") / F.col("_all") * UNIT).cast("long"), F.lit(UNIT)))
    cut = cut.withColumn("hi", end).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long")))
    return cut.select("s", "blocks", "lo", "hi", F.round("_slots").cast("long").alias("want"), F.round("_all").cast("long").alias("slots"))


def _times(x: Column, factor: int) -> Column:
    """x * factor mod UNIT, for x below 2 ** 32, without leaving 63 bits."""
    high, low = factor >> LOW_BITS, factor & ((1 << LOW_BITS) - 1)
    return F.pmod(F.pmod(x * F.lit(high), F.lit(1 << (UNIT_BITS - LOW_BITS))) * F.lit(1 << LOW_BITS) + F.pmod(x * F.lit(low), F.lit(UNIT)), F.lit(UNIT))


def _point(slot: Column) -> Column:
    """slot * GOLDEN mod UNIT."""
    high = _times(F.shiftright(slot, LOW_BITS), (GOLDEN << LOW_BITS) % UNIT)
    return F.pmod(high + _times(slot.bitwiseAND(F.lit((1 << LOW_BITS) - 1)), GOLDEN), F.lit(UNIT))


def schedule(intervals: DataFrame, slots: int) -> DataFrame:
    """slot, s, rank, pass and block: which block of which source each slot takes."""
    cell = lambda c: F.shiftright(c, UNIT_BITS - CELL_BITS)
    cells = intervals.filter("lo < hi").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    spark = intervals.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    points = points.withColumn("cell", cell(F.col("u")))
    chosen = points.join(cells, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "s", "blocks", "want", F.floor(F.col("slot") / 4096).alias("run"))
    ranked = running(chosen, "s", "run", ["slot"], F.lit(1), "rank").filter(F.col("rank") < F.col("want")).select("slot", "s", "blocks", "rank")
    # what the points leave short of a target follows after them
    got = chosen.groupBy("s").agg(F.count(F.lit(1)).alias("got"))
    short = intervals.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).filter("got < want")
    late = short.select("s", "blocks", "got", F.explode(F.sequence(F.col("got"), F.col("want") - 1)).alias("rank"))
    last = F.max("s").over(Window.partitionBy()) + 1
    late = late.withColumn("slot", F.lit(slots) + (F.col("rank") - F.col("got")) * last + F.col("s")).select("slot", "s", "blocks", F.col("rank"))
    every = ranked.unionByName(late)
    return every.select("slot", "s", "rank", F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with source_size, target, taken and slots; the schedule.

    sized: key columns, source, size (long) and h (a long hash that shuffles). slots: for each
    time that the mix goes through the source, the first slot with a block of the document.
    """
    sized = durable(sized, "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, budget, most)
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK), F.least(F.col("source_size"), F.lit(LEAST_BLOCKS)))
    plan = durable(plan.withColumn("blocks", blocks), "mix-plan")
    intervals = durable(_intervals(plan), "mix-intervals")
    slots = intervals.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    timetable = schedule(intervals, int(slots)).filter(F.col("pass") < most)

    named = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    named = named.withColumn("bucket", F.shiftrightunsigned(F.col("h"), 64 - BUCKETS.bit_length() + 1))
    keys = [c for c in sized.columns if c not in ("source", "size", "h")]
    placed = running(named, "s", "bucket", ["h", *keys], F.col("size"), "start")
    # block b of a source has its words floor(b * size / blocks) to floor((b + 1) * size / blocks)
    edge = lambda b: F.call_function("div", b.cast("decimal(38,0)") * F.col("source_size"), F.col("blocks"))
    holder = lambda word: F.call_function("div", (word + 1).cast("decimal(38,0)") * F.col("blocks") - 1, F.col("source_size"))
    segments = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(holder(F.col("start")), holder(F.col("start") + F.col("size") - 1))))
    segments = segments.withColumn("words", F.least(F.col("start") + F.col("size"), edge(F.col("block") + 1)) - F.greatest(F.col("start"), edge(F.col("block"))))
    times = timetable.groupBy("s", "block").agg(F.sort_array(F.collect_list("slot")).alias("at"))  # at most `most`
    shown = [*keys, "source", "size", "source_size", "target", "start"]
    seen = F.coalesce(F.size("at"), F.lit(0))
    slots_of = F.array_compact(F.array(*[F.min(F.get("at", F.lit(turn))) for turn in range(most)]))
    taken = segments.join(times, ["s", "block"], "left").groupBy(*shown).agg(F.coalesce(F.sum(F.col("words") * F.greatest(seen, F.lit(0))), F.lit(0)).cast("long").alias("taken"), slots_of.alias("slots"))
    empty = placed.filter(F.col("size") == 0).select(*shown, F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<long>)").alias("slots"))
    return taken.unionByName(empty), timetable


def sizes(docs: DataFrame, *keys: str | Column, seed: int = SEED) -> DataFrame:
    """Key columns, source, size and the hash that shuffles, of each document."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keys, "source", words.alias("size"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("h"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and second_slot of every document."""
    slot = lambda i: F.get("slots", F.lit(i))
    return mix(sizes(docs, "doc_id"), **options)[0].select("doc_id", "size", "source_size", "target", "taken", slot(0).alias("first_slot"), slot(1).alias("second_slot"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the order of the schedule.

    A document cut by the last block of its source counts as taken if more than half of
    its words are. One without words stands for no words and is kept once, at a place of
    its own. Partitions are ranges of slots, and rows within them follow their slots.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda of: [F.col(f"{of}doc_id").alias("id"), F.xxhash64(f"{of}text").alias("text_hash"), F.xxhash64(f"{of}source").alias("source_hash")]
    keys = ["id", "text_hash", "source_hash"]
    taken, _ = mix(sizes(docs, *own("")), **options)
    # rows of equal keys are interchangeable
    each = taken.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.min("slots").alias("slots"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    each = durable(each.withColumn("copies", copies).filter("copies > 0"), "mix-chosen")
    sweep(docs.sparkSession)
    slots = int(each.agg(F.coalesce(F.max(F.array_max("slots")), F.lit(0))).first()[0]) + 1
    anywhere = F.pmod(F.xxhash64(*keys), F.lit(slots))
    turns = each.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    turns = turns.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.get("slots", F.col("turn")), F.get("slots", F.lit(0)), anywhere).alias("slot"))
    packed = docs.select(F.struct("*").alias("row")).select(*own("row."), "row")
    met = packed.join(turns, packed["id"].eqNullSafe(turns["of_id"]) & (F.col("text_hash") == F.col("of_text_hash")) & (F.col("source_hash") == F.col("of_source_hash")))
    ordered = met.repartitionById(parts, F.floor(F.col("slot").cast("decimal(38,0)") * parts / slots).cast("int")).sortWithinPartitions("slot", *keys)
    return ordered.select("row.*")
