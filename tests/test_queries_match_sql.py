"""Every registered query with an SQL twin gives the same rows as DuckDB on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from probspark import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(9) + 0.0
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or v != v else str(v).replace(" 00:00:00", ""))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    got, want = normal(plans.queries()[name](spark, DATA).toPandas()), normal(duck.sql(plans.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.array_equal(got[c], want[c].astype(float), equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_ratings_take_every_pair_of_suppliers_and_every_period(spark, tmp_path):
    """Of an order's suppliers the first and the last alone had played, and the SQL ended after eight periods."""
    years = range(1990, 2000)
    orders = pd.DataFrame({"o_orderkey": range(10), "o_orderdate": pd.to_datetime([f"{y}-05-01" for y in years])})
    lines = pd.DataFrame([(o, s, 100.0 * (1 + (s * 7 + o) % 5)) for o in range(10) for s in (1, 2, 3, 4, 4) if s != 1 or o], columns=["l_orderkey", "l_suppkey", "l_extendedprice"])
    connection = duckdb.connect()
    for name, table in (("orders", orders), ("lineitem", lines), ("supplier", pd.DataFrame({"s_suppkey": range(1, 6)}))):
        spark.createDataFrame(table).write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = normal(plans.queries()["g15_period_ratings"](spark, str(tmp_path)).toPandas())
    want = normal(connection.sql(plans.oracle_sql()["g15_period_ratings"]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    games = {(r.period, r.team): r.games for r in got.itertuples()}
    assert len(games) == 50 and all(games[y, t] == (0 if t == 5 else 3 * k - 3 if t == 1 else 3 * k - 1) for k, y in enumerate(years, 1) for t in range(1, 6))


def test_entry_has_every_query(spark):
    import __spark_entry__

    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
