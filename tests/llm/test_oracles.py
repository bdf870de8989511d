import duckdb
import pytest

from checks.compare import TABLES, rows_of
from gridtide.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_give_the_same_rows(spark, db, name):
    result = QUERIES[name](spark, SF)
    answer = db.execute(ORACLES[name])
    columns, expected = [d[0] for d in answer.description], answer.fetchall()
    assert sorted(result.columns) == sorted(columns)
    assert rows_of(result.columns, [tuple(r) for r in result.collect()]) == rows_of(columns, expected)
