"""Trailing totals against sums over slices."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aislewise.operators.rolling import trailing_sums, trailing_totals


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(1, 45))
def test_trailing_sums(values, window):
    daily = np.array([values, values[::-1]])
    expect = [[row[max(0, i - window + 1) : i + 1].sum() for i in range(len(row))] for row in daily]
    assert trailing_sums(daily, window).tolist() == expect


def test_trailing_totals(spark):
    d = dt.date
    rows = [
        (1, d(2024, 1, 1), 100, 1, "x"), (1, d(2024, 1, 1), 100, 1, "x"), (1, d(2024, 1, 3), None, 2, "x"), (1, d(2024, 1, 4), -40, 3, "x"),
        (2, d(2024, 1, 5), 7, None, "x"), (2, d(2024, 1, 5), 7, None, "x"), (None, d(2024, 1, 5), 9, 4, "x"), (3, None, 9, 5, "x"), (4, d(2023, 12, 31), 9, 6, "x"),
    ]
    df = spark.createDataFrame(rows, "e int, day date, c bigint, id int, total_2 string")
    out = trailing_totals(df, "e", "day", F.col("c"), d(2024, 1, 1), d(2024, 1, 6), [2, 4], "id")
    got = {(r["e"], r["day"].day): (r["total_2"], r["average_2"], r["total_4"]) for r in out.collect()}
    assert len(got) == 12
    assert [got[1, i][0] for i in range(1, 7)] == [100, 100, 0, -40, -40, 0]
    assert [got[1, i][2] for i in range(1, 7)] == [100, 100, 100, 60, -40, -40]
    assert got[2, 5] == (14, 7.0, 14) and got[2, 6] == (14, 7.0, 14)
    few = trailing_totals(df, "e", "day", F.col("c"), d(2024, 1, 1), d(2024, 1, 6), [2], "id", {2: 13})
    assert {(r["e"], r["day"].day) for r in few.collect()} == {(1, 1), (1, 2), (2, 5), (2, 6)}
    assert trailing_totals(df.limit(0), "e", "day", F.col("c"), d(2024, 1, 1), d(2024, 1, 6), [2]).count() == 0
