"""Every registered query with SQL gives the rows that DuckDB gives for it on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from foldlake.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def cell(v):
    if pd.isna(v):
        return "~"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(pdf):
    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert len(QUERIES[name](spark, sf).columns) == len(set(QUERIES[name](spark, sf).columns))
    assert QUERIES[name](spark, sf).count() > 0


def test_token_bucket_equals_fold(spark, sf):
    from foldlake.sources.tables import feed

    at = {r["seq"]: r["authored_ms"] for r in feed(spark, sf).select("seq", "authored_ms").collect()}
    got = QUERIES["rate_limit_outcomes"](spark, sf).toPandas()
    for _, own in got.groupby("key"):
        tokens, last = 5.0, None
        for _, r in own.sort_values(["at_ms", "id"]).iterrows():
            assert r["at_ms"] == at[r["id"]]
            tokens = min(5.0, tokens + (r["at_ms"] - (r["at_ms"] if last is None else last)) / 1000 / 86_400)
            last = r["at_ms"]
            assert r["allowed"] == (tokens >= 1)
            tokens -= tokens >= 1
