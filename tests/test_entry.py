import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "docloom.plans.queries" in {f.__module__ for f in entry.queries().values()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from docloom.plans.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name, query in QUERIES.items():
        got = query(spark, SF)
        columns = sorted(got.columns)
        rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
        if name in ORACLES:
            want = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
            assert rows == sorted(map(repr, want)), name
