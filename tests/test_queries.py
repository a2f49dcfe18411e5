"""Every query of the engine that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from quernwork.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


def norm(pdf):
    def text(v):
        if str(v) in ("None", "nan", "NaT", "<NA>"):
            return "NULL"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}".rstrip("0").rstrip(".")
        return str(v)

    cols = sorted(pdf.columns)
    return sorted(tuple(text(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), cols


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    assert norm(Q[name](spark, sf).toPandas()) == norm(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    rows = Q[name](spark, sf).collect()
    assert len(rows) == len(set(map(str, rows))) or name in ("description_pay", "html_texts")  # every row is another one
