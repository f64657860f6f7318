"""What the driver relies on."""

import __spark_entry__ as entry
import pytest

from graphloom.operators import scorecard
from graphloom.plans import registry


def test_every_relational_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()
    assert registry.queries().keys() <= entry.queries().keys()


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("n", [1, 5, 6, 7, 10, 21, 1000])
def test_p95_is_by_place(spark, n):
    values = [(x * 7919) % 1013 for x in range(n)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = sorted(values)[(int(n * 0.95) if n > 5 else n) - 1]
    assert scorecard.p95(df, "v").first().p95 == want == scorecard.p95(df, "v", bins=8, few=3).first().p95
