"""Every registered query of the reference's operators against its SQL, by value."""

from __future__ import annotations

import math

import duckdb
import pytest

from quire.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, oracle, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(tuple(map(told, r)) for r in df.select(*names).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    got = oracle.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert sorted(tuple(told(r[k]) for k in order) for r in got.fetchall()) == rows
