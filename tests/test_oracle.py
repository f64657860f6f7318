"""Every query against its SQL on the same tables."""

import os

import duckdb
import pytest

from graphloom.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, db, name):
    ours = registry.queries()[name](spark, SF)
    theirs = db.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got, want = plain(ours.collect(), ours.columns), plain(theirs.fetchall(), theirs.columns)
    assert len(got) > 0 and got == want
