"""Every query with SQL gives the rows that DuckDB gives, over whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lexmill.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")


def rows(frame):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    found = QUERIES[name](spark, DATA).count()
    assert found > 0 or name == "source_conflicts"  # the smallest tables hold none


def test_measured_outcomes(spark):
    found = {r["outcome"]: r["n_docs"] for r in QUERIES["clean_outcomes"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {"accepted": 917, "duplicate": 71, "too_short": 7, "too_long": 5}
