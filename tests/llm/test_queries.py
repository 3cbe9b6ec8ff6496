import pytest

from repeatloom.llm.queries import QUERIES, SQL
from tests.conftest import DATA


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("families", "family_similarity", "probes", "reads", "runs", "documents", "common_words", "mix_targets"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(columns)
    even = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(even(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=key)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == order
    assert sorted((tuple(even(r[c]) for c in order) for r in df.collect()), key=key) == want
