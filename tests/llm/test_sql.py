"""Queries with SQL give the rows that DuckDB gives, on given tables and on the hard cases."""

import duckdb
import pytest

from foldlake.llm.queries import oracle_sql, queries
from tests.llm.fixtures import DOCS, rows as hard_rows
from tests.test_catalog import rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got, want = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_minhash", "op6_lines", "op8_suffix"])
def test_hard_rows_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(hard_rows(), DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries()[name](spark, str(tmp_path)).toPandas(), con.execute(oracle_sql()[name]).df()
    assert rows(got) == rows(want)
