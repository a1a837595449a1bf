"""Queries that SQL can say, against DuckDB on whole tables."""
import duckdb
import pytest

from sellerscope.llm import queries as q

from .conftest import SF

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = q.QUERIES[name](spark, SF)
    cur = con.execute(q.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))
