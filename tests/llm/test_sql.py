"""The llm queries that have SQL, against it, by value."""

from __future__ import annotations

import duckdb
import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    told = lambda row: tuple(round(v, 3) if isinstance(v, float) else v for v in row)
    want = sorted((told(x) for x in cursor.fetchall()), key=str)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((told(x) for x in df.select(*names).collect()), key=str) == want
