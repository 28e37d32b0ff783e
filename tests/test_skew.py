"""Skew-safe results against plain computations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from aislewise.operators import skew


def rows_of(spark, hot=3000, seed=1):
    rng = random.Random(seed)
    rows = [(7, rng.choice([None, float("nan"), 2.5, rng.uniform(-5, 5)]), "x") for _ in range(hot)]
    rows += [(rng.randint(0, 40), round(rng.uniform(-3, 9), 1), "y") for _ in range(800)]
    rows += [(None, 1.0, "z")] * 50 + [(99, None, "z")]
    return spark.createDataFrame(rows, "k int, v double, extra string"), rows


def plain_ranks(rows):
    by = {}
    for k, v, _ in rows:
        if k is not None and v is not None and v == v:
            by.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize(("bins", "sent"), [(1024, 50_000), (4, 50_000), (4, 0)])
def test_exact_ranks(spark, monkeypatch, bins, sent):
    monkeypatch.setattr(skew, "BINS", bins)
    monkeypatch.setattr(skew, "SENT_INTERVALS", sent)
    df, rows = rows_of(spark, 500)
    wanted = F.array(F.lit(1), F.lit(5), F.ceil(F.col("n") / 2), F.col("n"), F.col("n") + 1).cast("array<bigint>")
    got = {(r["k"], r["rank"]): (r["v"], r["equal"]) for r in skew.exact_ranks(df, "k", "v", F.array_distinct(wanted)).collect()}
    expect = {}
    for k, values in plain_ranks(rows).items():
        for rank in {1, 5, -(-len(values) // 2), len(values)}:
            if rank <= len(values):
                expect[k, rank] = (values[rank - 1], values.count(values[rank - 1]))
    assert got == expect


EXTREMES = {
    "double": [float("inf")] * 5 + [float("-inf")] * 3 + [1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1e-300, 2.5, 2.5, float("nan")] * 7,
    "bigint": [2**63 - 1, -(2**63), 2**63 - 2, 2**62, -(2**62), 2**62 + 1, 0, 1, None] * 9,
    "float": [float("inf"), 1.5, -3.0, float("-inf"), 3.4e38, -3.4e38],
    "int": [2**31 - 1, -(2**31), 0, 5, 5],
    "decimal(38,0)": [__import__("decimal").Decimal(x) for x in (10**37 * 9, -(10**37) * 9, 1, 2, 2)],
}


@pytest.mark.parametrize("kind", EXTREMES)
@pytest.mark.parametrize("sent", [50_000, 0])
def test_extreme_values(spark, monkeypatch, kind, sent):
    """Infinities, the ends of a type and values that differ by one at its end: each rank of each key."""
    monkeypatch.setattr(skew, "BINS", 100)
    monkeypatch.setattr(skew, "SENT_INTERVALS", sent)
    values = EXTREMES[kind]
    df = spark.createDataFrame([(k, x) for k in (1, 2) for x in values] + [(3, values[0])] * 4, f"k int, v {kind}")
    got = {(r["k"], r["rank"]): (r["v"], r["equal"]) for r in skew.exact_ranks(df, "k", "v", F.sequence(F.lit(1).cast("bigint"), F.col("n"))).collect()}
    kept = sorted(x for x in values if x is not None and x == x)
    kept = [r[0] for r in spark.createDataFrame([(x,) for x in kept], f"v {kind}").collect()]
    expect = {(k, i): (x, kept.count(x)) for k in (1, 2) for i, x in enumerate(kept, 1)} | {(3, i): (values[0], 4) for i in (1, 2, 3, 4)}
    assert got == expect


def test_many_keys_without_a_join_on_the_bare_key(spark, monkeypatch):
    """60,000 keys and a hot one with salt: right results, and no exchange of rows by the key alone."""
    monkeypatch.setattr(skew, "SENT_INTERVALS", 0)
    seen = []
    within = skew._within
    monkeypatch.setattr(skew, "_within", lambda *a: seen.append(within(*a)) or seen[-1])
    df = spark.sql("SELECT IF(id < 120000, id % 60000, -1) AS k, CAST(id * 7919 % 100003 AS INT) AS v FROM range(180000)")
    got = skew.key_quantiles(df, "k", "v", [0.5])
    expect = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("v")).alias("all")).select("k", "n", F.element_at("all", F.ceil(F.col("n") / 2).cast("int")).alias("p50"))
    assert got.count() == 60_001 and got.exceptAll(expect).count() == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("salt" in line for line in moved)
    assert not any(re.search(r"hashpartitioning\(k#\d+L?, \d+\)", line) for line in moved)


def test_quantiles_dates_and_empty(spark):
    df = spark.sql("SELECT 1 AS k, date_add(DATE '2024-01-01', CAST(id AS INT)) AS v FROM range(2000)")
    row = skew.key_quantiles(df, "k", "v", [0.5]).collect()[0]
    assert (row["n"], str(row["p50"])) == (2000, "2026-09-26")
    assert skew.key_quantiles(df.limit(0), "k", "v", [0.5]).count() == 0


def test_frequent_keys(spark):
    rows = [(1, 5)] * 60 + [(2, 6)] * 40 + [(i, None) for i in range(10, 110)] + [(None, 7)] * 4
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r["field"], r["key_id"], r["rows"]) for r in skew.frequent_keys(df, ["a", "b"], 40 / 204).collect()}
    assert got == {("a", 1, 60), ("a", 2, 40), ("b", 5, 60), ("b", 6, 40)}
    assert skew.frequent_keys(df.limit(0), ["a", "b"], 0.02).count() == 0


def test_key_totals(spark):
    rows = [(1, 10, 5, 100), (1, 10, 5, 100), (1, 11, 5, None), (None, 12, 5, 7), (2, None, 6, 9)]
    df = spark.createDataFrame(rows, "a int, t int, b int, c bigint")
    got = {tuple(r) for r in skew.key_totals(df, ["a", "b"], "t", F.col("c")).collect()}
    assert got == {("a", 1, 3, 2, 100), ("a", 2, 1, 0, 0), ("b", 5, 4, 3, 107), ("b", 6, 1, 0, 0)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([(1, i, "l") for i in range(300)] + [(1, 7, "l")] * 200 + [(i, i, "l") for i in range(2, 30)] + [(None, 1, "l")], "k int, x int, same string")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d"), (50, "e")], "k int, same string")
    got = sorted(map(tuple, skew.skew_join(left, right.withColumnRenamed("same", "other"), "k", how).collect()), key=str)
    plain = left.join(right.withColumnRenamed("same", "other"), "k", how)
    assert got == sorted(map(tuple, plain.collect()), key=str)
    assert len(skew.skew_join(left, right, "k", how).columns) == 4  # clashing names come out twice
    assert skew.skew_join(left.limit(0), right, "k", how).count() == 0
    with pytest.raises(ValueError, match="inner or left"):
        skew.skew_join(left, right, "k", "outer")
