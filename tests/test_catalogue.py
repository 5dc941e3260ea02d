"""Every query of the catalogue against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from stratalyn.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    def shown(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    mine, theirs = catalogue.queries()[name](spark, str(DATA)).toPandas(), duck.sql(catalogue.oracles()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry_reads_the_smallest_tables(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
