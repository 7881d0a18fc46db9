"""Every registered query with an oracle gives DuckDB's rows; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from duoply import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def text(v) -> str:
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "NULL"
    return str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool" else f"{float(v):.5f}" if hasattr(v, "__float__") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
