"""Queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from veilmetrics.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"d09_dark_grid", "d16_two_resolutions", "v04_components", "v05_dominant_component"}  # render every page; d13 and v06 do so too
NAMES = sorted(set(registry.oracle_sql()) - SLOW)


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "None"
    return repr(float(v)) if pd.api.types.is_number(v) and not pd.api.types.is_bool(v) else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns)
    assert rows(pd.DataFrame(got)) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
