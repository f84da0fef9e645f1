"""The driver contract: every query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from planewise.plans import analysis, coding

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = analysis.QUERIES | coding.QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in rows), key=str)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["tensor", "plane", "total", "symbols", "bits"] and df.count() == 20


def test_names():
    assert set(CORE) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf_dir, oracle, name):
    df = CORE[name](spark, sf_dir)
    names = sorted(df.columns)
    got = _rows(df.select(names).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = oracle.sql(sql)
    assert sorted(rel.columns) == names
    assert got == _rows(rel.project(", ".join(f'"{c}"' for c in names)).fetchall())
