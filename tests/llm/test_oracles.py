"""Queries that SQL can express, against DuckDB on the smallest driver tables."""

from pathlib import Path

import pytest

from quern.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, str(SF)).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
