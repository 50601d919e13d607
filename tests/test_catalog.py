"""Every catalogue query against its oracle on the smallest driver tables."""

import decimal
from pathlib import Path

import pandas as pd
import pytest

from quern.catalog import queries as Q

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v

    return sorted(tuple(str(value(v)) if not isinstance(value(v), int) or isinstance(v, bool) else str(float(v)) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = Q.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:  # whole numbers that pandas holds as doubles for their nulls
        for f in (got, want):
            if pd.api.types.is_integer_dtype(f[c]):
                f[c] = f[c].astype("float64")
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_an_oracle():
    assert set(Q.QUERIES) == set(Q.ORACLES)


def test_missing_tasks_has_no_bound_on_types(spark, tmp_path):
    from quern.catalog import queries as catalog

    spark.createDataFrame([(1, f"t{i:04d}") for i in range(1500)] + [(2, "t0000"), (3, "refund")], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.missing for r in catalog.QUERIES["q_missing_tasks"](spark, str(tmp_path)).collect()}
    types = [f"t{i:04d}" for i in range(1500)]
    assert got == {1: "refund", 2: ",".join(["refund", *types[1:]]), 3: ",".join(types)}
