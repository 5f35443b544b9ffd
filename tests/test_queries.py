import duckdb
import pytest

from terramark.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = db.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])
