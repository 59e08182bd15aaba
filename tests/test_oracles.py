import duckdb
import pytest

from loamgrid.plans import ORACLES, QUERIES

TABLES = "orders events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    c = duck.sql(ORACLES[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(c.fetchall(), c.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
