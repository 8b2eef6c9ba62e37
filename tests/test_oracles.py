"""Each registered query against its DuckDB SQL on the smallest tables, and the contract of the entry module."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from terralog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def text(v):
        if isinstance(v, float):
            return f"{v + 0:.6g}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple("" if pd.isna(v) else text(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalogue.queries()[name](spark, SF).toPandas()) == plain(duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).columns


def test_entry_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
