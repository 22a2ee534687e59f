"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from sparkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table, columns):
    return sorted(repr(tuple(None if v is None else round(float(v), 9) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in r)) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    want = want.select(*(duckdb.ColumnExpression(x) for x in cols)).fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert len(got) == len(want) and len(got) > 0
    assert rows(got, cols) == rows(want, cols)
