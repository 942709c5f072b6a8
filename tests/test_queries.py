"""Every catalogue query beside its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from tracequarry.plans.catalogue import ORACLES, QUERIES
from verify_local import bag

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, got) == bag(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
