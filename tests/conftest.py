"""One small session for all tests."""

import pytest

from aislewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark_driver_memory="4g", spark_sql_shuffle_partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(x):
    import math

    import numpy as np
    import pandas as pd

    if isinstance(x, (list, tuple, np.ndarray)):
        return str([_plain(y) for y in x])
    if x is None or x is pd.NaT or (not isinstance(x, str) and pd.isna(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return format(float(x), ".9g") if abs(x) < 1e8 else str(int(x))
    if isinstance(x, (float, np.floating)):
        return "NULL" if math.isnan(x) else format(float(x) + 0.0, ".9g")
    return str(x).removesuffix(" 00:00:00")


@pytest.fixture(scope="session")
def same(spark):
    """A function that compares a query with its SQL on the smallest tables."""
    from pathlib import Path

    import duckdb

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")

    def rows(df):
        return sorted(map(tuple, df[sorted(df.columns)].astype(object).map(_plain).to_numpy().tolist()))

    def compare(query, sql, tested_elsewhere=False):
        got = query(spark, str(folder)).toPandas()
        if sql is None:
            assert tested_elsewhere, "the query has neither SQL nor a test of its own"
            assert len(got.columns)
            return
        expect = con.execute(sql).df()
        assert sorted(got.columns) == sorted(expect.columns)
        assert rows(got) == rows(expect)

    return compare
