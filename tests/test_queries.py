import pytest

import __spark_entry__ as entry
from repeatloom.plans.queries import QUERIES
from repeatloom.plans.sql import SQL
from tests.conftest import DATA


def test_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("array_hits", "families", "family_similarity", "probes", "raw_records", "reads", "runs"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    even = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(even(r[c]) for c in sorted(columns)) for r in df.collect()), key=key)
    assert got == sorted((tuple(even(r[c]) for c in sorted(columns)) for r in want), key=key)
