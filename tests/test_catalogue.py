"""Every registered query that SQL can say, against DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from veilspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sql):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    rel = sql.sql(catalogue.SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
