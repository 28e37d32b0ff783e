"""Shapes of plans that matter at scale: pruned scans, pushed filters, no products of tables."""

import re

import pytest

from aislewise.plans import registry

FOLDER = "/root/testdata/sf0.001"
NARROW = {
    "A1": ("customer_id", "store_id", "product_id", "total", "date"), "A2": ("product_id", "quantity", "total", "date"), "A4": ("customer_id", "product_id", "total", "date"),
    "P9": ("transaction_id", "customer_id", "total"), "p2_totals": ("transaction_id", "customer_id", "product_id", "total"), "p6_found": ("transaction_id", "customer_id", "date", "subtotal"),
}


def plan_of(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(NARROW))
def test_scans_read_what_is_needed(spark, name):
    read = {c for fields in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, name)) for c in re.findall(r"(\w+):", fields)}
    assert read <= set(NARROW[name])


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(customer_id,100)" in plan_of(spark, "P9")
    assert "GreaterThanOrEqual(date,2024-01-01)" in plan_of(spark, "p6_found")


@pytest.mark.parametrize("name", ["A1", "A3", "A5", "R2", "R4", "R5", "J3", "J5", "p2_totals", "p2_join", "p6_found"])
def test_no_products_of_tables(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    if name != "R2":  # it meets one row of thresholds
        assert "BroadcastNestedLoopJoin" not in plan
