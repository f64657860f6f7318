"""What the loop of strong components sends through the driver."""

from graphloom.operators import graph


def test_strong_components_broadcast_no_table(spark, monkeypatch):
    plans, write = [], graph.durable

    def watched(df, name="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "durable", watched)
    pairs = [(i, (i + 1) % 30) for i in range(30)] + [(40, 41), (41, 42), (42, 40), (41, 40), (5, 40), (50, 51)]
    found = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"))
    got = {(r.id, r.component, r.size) for r in found.collect()}
    assert got == {(i, 0, 30) for i in range(30)} | {(i, 40, 3) for i in (40, 41, 42)}
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])
