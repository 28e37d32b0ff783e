"""Data-quality checks and range verdicts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distances from a range, in half-spans, up to which a value passes or is worth a warning. The thresholds
#: 0.2 and 0.5 are divided by the first of them plus 0.01.
PASS_AWAY, WARN_AWAY = 0.2 / (0.2 + 0.01), 0.5 / (0.2 + 0.01)


def check(name: str, counted: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(check, value, passed) of a one-row, one-column count that should lie in [low, high]."""
    value = F.col(counted.columns[0]).cast("bigint")
    ok: Column = F.lit(True)
    if low is not None:
        ok &= F.col("value") >= low
    if high is not None:
        ok &= F.col("value") <= high
    return counted.select(F.lit(name).alias("check"), value.alias("value")).withColumn("passed", ok)


def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct values of `key` in `fact`, NULL aside, that `dimension` doesn't have."""
    return fact.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def count_where(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(condition).agg(F.count(F.lit(1)).alias("n"))


def warehouse_checks(tables: Mapping[str, DataFrame], least: Mapping[str, int], first_day: str, last_day: str) -> DataFrame:
    """All checks as one table: row counts, keys, orphans, ranges."""
    tx, products, customers, stores = (tables[t] for t in ("transactions", "products", "customers", "stores"))
    counts = [check(f"{t} rows", tables[t].agg(F.count(F.lit(1)).alias("n")), low=n) for t, n in least.items()]
    outside = (F.col("date") < F.lit(first_day).cast("date")) | (F.col("date") > F.lit(last_day).cast("date"))
    rest = [
        check("null customer_id", count_where(customers, "customer_id IS NULL"), high=0),
        check("null product_id", count_where(products, "product_id IS NULL"), high=0),
        check("repeated store_id", stores.groupBy("store_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")), high=0),
        check("orphan customers", orphans(tx, customers, "customer_id").agg(F.count(F.lit(1)).alias("n")), high=0),
        check("orphan products", orphans(tx, products, "product_id").agg(F.count(F.lit(1)).alias("n")), high=0),
        check("days outside", count_where(tx, outside), high=0),
        check("negative totals", count_where(tx, "total < 0"), high=0),
        check("prices not positive", count_where(products, "price <= 0"), high=0),
        check("ages outside", count_where(customers, "age < 18 OR age > 100"), high=0),
    ]
    return reduce(DataFrame.unionByName, [*counts, *rest])


def validation_checks(tables: Mapping[str, DataFrame], more_than: Mapping[str, int]) -> DataFrame:
    """The shorter suite: row counts above a limit, absent ids, ranges, and ids of purchases that the dimensions lack, NULL among them, as figures."""
    tx, products, customers = (tables[t] for t in ("transactions", "products", "customers"))
    counts = [check(f"{t} count", tables[t].agg(F.count(F.lit(1)).alias("n")), low=n + 1) for t, n in more_than.items()]

    def unknown(dimension: DataFrame, key: str) -> DataFrame:
        return tx.select(key).distinct().join(dimension.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))

    rest = [
        check("null customer_id", count_where(customers, "customer_id IS NULL"), high=0),
        check("null product_id", count_where(products, "product_id IS NULL"), high=0),
        check("prices positive", count_where(products, "price <= 0"), high=0),
        check("ages in range", count_where(customers, "age < 18 OR age > 100"), high=0),
        check("customers of purchases", unknown(customers, "customer_id")),
        check("products of purchases", unknown(products, "product_id")),
        check("no negative totals", count_where(tx, "total < 0"), high=0),
    ]
    return reduce(DataFrame.unionByName, [*counts, *rest])


def compared(value: Column, target: Column, passes: float = 0.20, warns: float = 0.35) -> Column:
    """PASS, WARN or FAIL by the distance from a target, as a share of it."""
    away = F.abs((value - target) / F.nullif(target, F.lit(0.0)))
    return F.when(away.isNull(), None).when(away <= passes, "PASS").when(away <= warns, "WARN").otherwise("FAIL")


def verdict(value: Column, low: Column, high: Column) -> Column:
    """PASS inside the range or barely outside, WARN up to about two and a half half-spans from it, else FAIL. NULL stays NULL."""
    half = F.when(high == low, F.greatest(F.abs(low) * 0.1, F.lit(1e-12))).otherwise((high - low) / 2)
    away = F.greatest(low - value, value - high, F.lit(0.0)) / half
    return F.when(value.isNull(), None).when(away <= PASS_AWAY, "PASS").when(away <= WARN_AWAY, "WARN").otherwise("FAIL")
