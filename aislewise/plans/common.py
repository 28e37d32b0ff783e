"""Helpers of the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislewise.tables import table

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("stores", "products", "customers", "coupon_clips", "transactions", "recommendations", "embeddings", "documents", "events", "split_limits", "eval_items")


class Tables:
    """Tables of one folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A Spark SQL statement in which {name} is a table of the folder or one of `frames`."""
        for name in set(re.findall(r"\{(\w+)\}", text)):
            if name not in frames:
                frames[name] = table(self.spark, self.sf_dir, name)
        return self.spark.sql(text, **frames)


class Book:
    """Collects queries and their SQL under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: query(Tables(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql

    def both(self, name: str, text: str) -> None:
        """A statement that both engines read alike."""
        self.add(name, lambda t: t.sql(text), re.sub(r"\{(\w+)\}", r"\1", text))
