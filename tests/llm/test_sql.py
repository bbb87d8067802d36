"""The corpus queries that have SQL against it in DuckDB, on the smallest tables."""

import duckdb
import pytest

from prismview.llm import queries

from .test_operators import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(x) for x in r) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want
