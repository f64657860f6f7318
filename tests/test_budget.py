"""The cut to a token budget, over more lines than one task should hold."""

from pyspark.sql import functions as F

from graphloom.operators.search import budget_cut


def by_hand(lines, limit):
    used, out = 0, []
    for ord_, line in sorted(lines, key=lambda x: x[0]):
        used += -(-len(line or "") // 4) + 1
        if used > max(64, limit) - 12:
            break
        out.append((ord_, used))
    return out


def test_a_cut_without_a_group_sums_no_more_lines_than_fit(spark):
    for lines in ([(i, "x" * (i * 7 % 40)) for i in range(300)], [(i, "" if i % 2 else None) for i in range(300)], [(0, "y" * 5000), (1, "z")], []):
        df = spark.createDataFrame(lines, "ord long, line string").repartition(4)
        for limit in (10, 64, 200):
            assert [(r.ord, r.used) for r in budget_cut(df, limit).orderBy("ord").collect()] == by_hand(lines, limit)


def test_the_first_lines_are_picked_before_the_window(spark):
    many = spark.range(200_000).select(F.col("id").alias("ord"), F.lit("abcd").alias("line"))
    cut = budget_cut(many, 100)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("TakeOrderedAndProject(limit=88")
    assert [r.ord for r in cut.orderBy("ord").collect()] == list(range(44))
