"""Graph operators over (nodes, edges) DataFrames: degrees, hops, reach, components, pruning.

Edges have src, dst and kind; optional columns pass through where they make sense. Loops
write their state to the shared folder each round, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import discard, durable

VISITED_CAP = 20_000


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Edges of the given kinds, compared in lower case; unknown kinds give none."""
    return edges if kinds is None else edges.filter(F.col("kind").isin([k.lower() for k in kinds]))


def degrees(nodes: DataFrame, edges: DataFrame, within: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, indeg and outdeg of every node, or of those whose id lies within a part; containment does not count."""
    used = edges.filter("kind <> 'contains'")
    ends = used.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(used.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if within is not None:
        nodes, ends = nodes.filter(within(F.col("id"))), ends.filter(within(F.col("id")))
    summed = ends.groupBy("id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return nodes.join(summed, "id", "left").select(*nodes.columns, F.coalesce("indeg", F.lit(0)).alias("indeg"), F.coalesce("outdeg", F.lit(0)).alias("outdeg"))


def map_sizes(edges: DataFrame, base: float = 1.0, most: int = 40) -> DataFrame:
    """id, degree with containment, and the drawn size base + sqrt(min(degree, most))."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).withColumn("size", F.lit(base) + F.sqrt(F.least("degree", F.lit(most)).cast("double")))


def file_hubs(edges: DataFrame) -> DataFrame:
    """id, importers and imports_out of every file with an import."""
    used = edges.filter("kind = 'imports'")
    ends = used.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(used.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("importers"), F.sum("o").alias("imports_out"))


def top(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows in a total order."""
    return df.orderBy(*order).limit(limit)


def one_hop(edges: DataFrame, target: str, direction: str, kind: str, limit: int | None = 500) -> DataFrame:
    """Neighbours of one node by one kind of edge, best confidence first, with the true total; all of them for no limit."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    conf = F.col("conf") if "conf" in edges.columns else F.lit(1.0)
    hit = edges.filter((F.col("kind") == kind) & (F.col(near) == target)).select(F.col(far).alias("id"), conf.alias("conf"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return (hit if limit is None else hit.orderBy(F.desc("conf"), "id").limit(limit)).join(F.broadcast(total))


#: Ids of a frontier that go into a filter as they are; more, up to the cap, are broadcast.
FEW = 500


def _beyond(edges: DataFrame, direction: str, at: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """id of the far ends of the edges that at(edges, near end) keeps."""
    sides = [(n, f) for n, f, d in (("src", "dst", "out"), ("dst", "src", "in")) if direction in (d, "both")]
    return reduce(DataFrame.unionAll, [at(edges, n).select(F.col(f).alias("id")) for n, f in sides]).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", cap: int | None = VISITED_CAP, near: Callable[[str, list], DataFrame] | None = None) -> DataFrame:
    """id, hop (least) and capped of all nodes within `depth` of the seeds (column id), these included.

    When more than `cap` nodes are found, those of least (hop, id) stay and capped is true. With
    a cap, what is seen is bounded by it and stays with the driver, and each hop is one job that
    reads the edges at its frontier: near(end, ids), if given, looks them up. Without a cap, or
    with more seeds than it, state is written each hop. No hop copies the edges.
    """
    spark, kind = edges.sparkSession, seeds.schema["id"].dataType.simpleString()
    first = [r.id for r in seeds.select("id").distinct().limit(cap + 1).collect()] if cap is not None else []
    if cap is None or len(first) > cap:
        return _reach_written(edges, seeds, depth, direction, cap)
    hops, frontier, capped = dict.fromkeys(first, 0), first, False
    for hop in range(1, depth + 1):
        local = spark.createDataFrame([(i,) for i in frontier], f"id {kind}")
        if len(frontier) > FEW:
            at = lambda e, end, ids=local: e.join(F.broadcast(ids.select(F.col("id").alias(end))), end, "left_semi")
        elif near is not None:
            at = lambda _, end, ids=tuple(frontier): near(end, list(ids))
        else:
            at = lambda e, end, ids=tuple(frontier): e.filter(F.col(end).isin(*ids))
        found, left = _beyond(edges, direction, at), cap - len(hops)
        if len(hops) <= FEW:
            found = found.filter(~F.col("id").isin(*hops))
        else:
            found = found.join(F.broadcast(spark.createDataFrame([(i,) for i in hops], f"id {kind}")), "id", "left_anti")
        frontier = [r.id for r in found.filter("id is not null").orderBy("id").limit(left + 1).collect()]
        capped = len(frontier) > left
        hops |= dict.fromkeys(frontier[:left], hop)
        if capped or not frontier:
            break
    return spark.createDataFrame([(i, h, capped) for i, h in hops.items()], f"id {kind}, hop int, capped boolean")


def _reach_written(edges: DataFrame, seeds: DataFrame, depth: int, direction: str, cap: int | None) -> DataFrame:
    """reach() for any number of nodes: one row a node, written each hop."""
    seen = durable(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "reach")
    frontier, capped = seen, False
    for hop in range(1, depth + 1):
        found = _beyond(edges, direction, lambda e, end, ids=frontier: e.join(ids.select(F.col("id").alias(end)), end, "left_semi"))
        frontier = durable(found.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionAll(frontier)
        if cap is not None and (n := seen.count()) > cap:
            frontier = frontier.orderBy("id").limit(max(0, cap - (n - frontier.count())))
            seen, capped = durable(seen.filter(F.col("hop") < hop).unionAll(frontier), "reach"), True
            break
    return seen.withColumn("capped", F.lit(capped))


def _merged(df: DataFrame) -> DataFrame:
    """df for a join whose sides meet by sorting: a loop that broadcasts its tables sends them all through the driver."""
    return df.hint("merge")


def _spread(rest: DataFrame, colour: DataFrame) -> DataFrame:
    """id and colour: of all nodes from which a node can be reached, the one of least rank, itself included.

    colour: written; each node's own rank and id. A step takes the least colour of those before a
    node and then the colour of that colour, whose reach goes further back, so paths shorten.
    """
    while True:
        came = rest.join(_merged(colour.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("came"))
        near = durable(colour.join(_merged(came), "id", "left").select("id", F.col("colour").alias("was"), F.least("colour", "came").alias("colour")), "scc-near")
        further = near.select(F.col("id").alias("of"), F.col("colour").alias("further"))
        step = near.withColumn("of", F.col("colour.of")).join(_merged(further), "of").select("id", "was", F.least("colour", "further").alias("colour"))
        step = durable(step, "scc-colour")
        discard(colour, near)
        colour = step.select("id", "colour")
        colour.path = step.path
        if not step.filter("was <> colour").limit(1).count():
            return colour


#: A round of shrinking follows another while it takes more than this share of the edges.
SHRINK = 1 / 16


def _shrunk(rest: DataFrame, passed: list[DataFrame]) -> DataFrame:
    """rest without nodes that have no edge in or none out, and with paths drawn together.

    A node with one edge in and one out lies on a cycle exactly when the nodes before and after
    it are one or share a component; it gives way to an edge between these, and (id, before,
    after) goes to passed. Of such nodes side by side the one of least rank goes, with ranks
    dealt anew each round, so a path of any length is gone in a number of rounds that grows with
    its logarithm.
    """
    before = rest.count()
    while before:
        into = rest.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("before"))
        out = rest.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("after"))
        live = durable(into.join(_merged(out), "id"), "scc-live")
        single = live.filter("i = 1 and o = 1").withColumn("rank", F.xxhash64("id", F.lit(len(passed))))
        beside = lambda c: single.select(F.col("id").alias(c), F.struct("rank", "id").alias(f"{c}_rank"))
        own = F.struct("rank", "id")
        least = single.join(_merged(beside("before")), "before", "left").join(_merged(beside("after")), "after", "left").filter((F.col("before_rank").isNull() | (own < F.col("before_rank"))) & (F.col("after_rank").isNull() | (own < F.col("after_rank"))))
        gone = durable(least.select("id", "before", "after"), "scc-passed")
        stay = live.select("id").join(_merged(gone), "id", "left_anti")
        kept = rest.join(_merged(stay.withColumnRenamed("id", "src")), "src", "left_semi").join(_merged(stay.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst")
        bridged = gone.filter("before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"))
        now = durable(kept.unionByName(bridged).distinct(), "scc-edges")
        passed.append(gone)
        after = now.count()
        discard(rest, live)
        rest = now
        if before - after <= SHRINK * before:
            break
        before = after
    return rest


def _regained(labels: DataFrame, passed: list[DataFrame]) -> DataFrame:
    """labels (id, colour) with the nodes on cycles that were passed over, the last passed first."""
    for gone in reversed(passed):
        if not gone.limit(1).count():
            continue
        end = lambda c: labels.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        both = gone.join(_merged(end("before")), "before", "left").join(_merged(end("after")), "after", "left")
        loop = F.col("before") == F.col("after")
        own = both.select("id", F.when(loop, F.coalesce("before_colour", "before")).when(F.col("before_colour") == F.col("after_colour"), F.col("before_colour")).alias("colour")).filter("colour is not null")
        anchors = both.filter(loop & F.col("before_colour").isNull()).select(F.col("before").alias("id"), F.col("before").alias("colour")).distinct()
        labels = labels.unionByName(durable(own.unionByName(anchors), "scc-regained"))
    return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least member) and size of every node on a cycle, by colouring.

    Each turn shrinks the graph, colours every node by what reaches it, cuts the edges between
    colours, and takes back, within a colour, what reaches its root, both by pointer jumping. The
    rest goes into the next turn with other ranks, until no edge is left; nodes that shrinking
    passed over come back at the end.
    """
    kind = edges.schema["src"].dataType.simpleString()
    rest = durable(edges.select("src", "dst").distinct().filter("src <> dst"), "scc-edges")
    found: list[DataFrame] = []
    passed: list[DataFrame] = []
    turn = 0
    while True:
        rest = _shrunk(rest, passed)
        if not rest.limit(1).count():
            break
        nodes = rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = _spread(rest, durable(nodes.select("id", F.struct(F.xxhash64("id", F.lit(turn)).alias("rank"), F.col("id").alias("of")).alias("colour")), "scc-colour"))
        inside = rest.join(_merged(colour.select(F.col("id").alias("src"), F.col("colour.of").alias("c"))), "src").join(_merged(colour.select(F.col("id").alias("dst"), F.col("colour.of").alias("d"))), "dst").filter("c = d").select("src", "dst")
        inside = durable(inside, "scc-inside")
        rank = F.when(F.col("id") == F.col("colour.of"), F.lit(-(1 << 63))).otherwise(F.greatest(F.xxhash64("id", F.lit(-1 - turn)), F.lit(1 - (1 << 63))))
        back = _spread(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), durable(colour.select("id", F.struct(rank.alias("rank"), F.col("id").alias("of")).alias("colour")), "scc-back"))
        member = durable(back.filter(F.col("colour.rank") == -(1 << 63)).select("id", F.col("colour.of").alias("colour")), "scc-members")
        found.append(member)
        after_ = durable(inside.join(_merged(member.select(F.col("id").alias("src"))), "src", "left_anti").join(_merged(member.select(F.col("id").alias("dst"))), "dst", "left_anti").select("src", "dst"), "scc-edges")
        discard(rest, inside, colour, back)
        rest, turn = after_, turn + 1
    none = edges.sparkSession.createDataFrame([], f"id {kind}, colour {kind}")
    every = reduce(DataFrame.unionAll, found) if found else none
    large = every.join(_merged(every.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")), "colour", "left_semi").select("id", "colour")
    every = _regained(large, passed)
    sizes = every.groupBy("colour").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return every.join(_merged(sizes), "colour").select("id", "component", "size")


def prune(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing: all structure, then classes and functions by degree.

    Modules, files and libraries stay; classes take at most 30 % of what is left, functions
    the rest; edges need both ends. nodes has kind and degree.
    """
    frame = nodes.filter(F.col("kind").isin("Module", "File", "Library"))
    left = max(0, limit - frame.count())
    pick = lambda kind, n: nodes.filter(F.col("kind") == kind).orderBy(F.desc("degree"), "id").limit(n)
    classes = pick("Class", int(left * 0.3))
    kept = frame.unionByName(classes).unionByName(pick("Function", left - min(int(left * 0.3), nodes.filter("kind = 'Class'").count())))
    ids = kept.select("id")
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, both


def pair_weights(edges: DataFrame, module: DataFrame) -> DataFrame:
    """a, b, kind, n and inside: edges between unordered pairs of modules (module: id, module)."""
    named = edges.join(module.select(F.col("id").alias("src"), F.col("module").alias("m")), "src").join(module.select(F.col("id").alias("dst"), F.col("module").alias("k")), "dst")
    return named.groupBy(F.least("m", "k").alias("a"), F.greatest("m", "k").alias("b"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == F.col("k")).alias("inside"))


def from_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges fit for a drawing: no loops, no repeats, no dangling ends."""
    ids = nodes.select("id").distinct()
    clean = edges.filter("src <> dst").dropDuplicates(["src", "dst", "kind"])
    return clean.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
