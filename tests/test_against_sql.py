"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from gaugeline.queries import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [
        tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order) for r in rows
    ]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = cells(got.columns, got.collect()), cells(columns, answer.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            if isinstance(x, float) and y is not None:
                assert x == pytest.approx(y, abs=1.1e-6)
            else:
                assert x == y


def test_every_query_is_known():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.queries())
    without = set(catalog.QUERIES) - set(catalog.SQL)
    assert without == {"quantile_scores", "quantile_bands", "model_report", "model_list"}


def test_entry(spark):
    df = contract.entry(spark)
    assert "DO_delta_24h" in df.columns and "Aerator_TLAG_60" in df.columns
