import duckdb
import pytest

from terramark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "conversations")


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    # Rows, not a frame of pandas, which would turn whole numbers with nulls into floats.
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])
