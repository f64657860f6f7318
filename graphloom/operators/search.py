"""Finding nodes by what a user types, and the cut of a text to a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import folded, folded_text, kinds_of


def resolve(nodes: DataFrame, target: str, kind: str | None = None, limit: int = 25) -> DataFrame:
    """The nodes of the first tier that matches, busiest first, with tier and total.

    Tiers: id; path:line; path:name; path suffix:name; exact file or directory path; exact
    name; path suffix; any part of name or path. The last two and the suffix ignore case.
    nodes: id, kind, name, path, line, indeg, outdeg.
    """
    path, _, last = target.rpartition(":")
    name, where, low = F.col("name"), F.coalesce("path", F.lit("")), folded_text(target)
    tiers = [F.col("id") == target]
    if path:
        tiers.append((where == path) & (F.col("line") == int(last)) if last.isdigit() else F.lit(False))
        tiers.append((where == path) & (name == last))
        tiers.append(folded(where).endswith("/" + folded_text(path)) & (name == last))
    else:
        tiers += [F.lit(False)] * 3
    tiers.append((where == target) & F.col("kind").isin("File", "Dir"))
    tiers.append(name == target)
    tiers.append(folded(where).endswith("/" + low) & F.col("kind").isin("File", "Dir"))
    tiers.append(folded(name).contains(low) | folded(where).contains(low))
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(tiers[i], i + 1).otherwise(tier)
    pool = nodes if kind is None else nodes.filter(F.col("kind").isin(kinds_of(kind)))
    hit = pool.withColumn("tier", tier).filter("tier is not null")
    best = hit.agg(F.min("tier").alias("tier"))
    first = hit.join(F.broadcast(best), "tier")
    total = first.agg(F.count(F.lit(1)).alias("total"))
    return first.orderBy(F.desc(F.col("indeg") + F.col("outdeg")), "id").limit(limit).join(F.broadcast(total))


def best_hit(nodes: DataFrame, text: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The one node with most links among those whose name or path holds the text, whatever the case; no row for none.

    nodes: id, kind, name, path and degree; nodes of hidden kinds are passed over. Ties go to the least id.
    """
    low = folded_text(text.strip())
    if not low:
        return nodes.limit(0)
    held = F.contains(folded(F.col("name")), F.lit(low)) | F.contains(folded(F.coalesce("path", F.lit(""))), F.lit(low))
    return nodes.filter(held & ~F.col("kind").isin(*hidden)).orderBy(F.desc("degree"), "id").limit(1)


def budget_cut(lines: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """Lines (ord, line) that fit the budget: a line costs its length over four, rounded up, plus one.

    The cut is sticky: once a line does not fit, none after it does. A null line costs as an empty
    one. As every line costs something, no more lines than the budget has tokens can fit: without
    a group the first so many by ord are taken task by task, and only they are summed.
    """
    most = max(64, limit) - 12
    cost = F.ceil(F.coalesce(F.length("line"), F.lit(0)) / 4) + 1
    order = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lines if group else lines.orderBy("ord").limit(most)
    return first.withColumn("used", F.sum(cost).over(order)).filter(F.col("used") <= most)
