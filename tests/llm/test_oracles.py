"""Corpus queries that SQL can express, against DuckDB."""

import math
from pathlib import Path

import pandas as pd
import pytest

from stratalyn.llm import queries

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not DATA.exists(), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    mine, theirs = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(queries.ORACLES[name]).df()
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)

    def rows(df):
        shown = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
        return sorted(tuple(shown(v) for v in r) for r in df[names].itertuples(index=False))

    # a column of whole numbers with nulls is read as floating point on one side
    number = lambda r: tuple(x[:-2] if x.endswith(".0") else x for x in r)
    assert [number(r) for r in rows(mine)] == [number(r) for r in rows(theirs)]
