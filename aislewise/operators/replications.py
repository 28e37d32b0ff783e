"""Seeded replications: draws that depend on their keys only, so that partitioning and repeated tasks change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.scalar import draw, ratio


def replicate(df: DataFrame, runs: int, epochs: int) -> DataFrame:
    """Each row once per run and epoch, with columns run and epoch; nothing is shuffled."""
    spread = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return spread.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def responses(offers: DataFrame, runs: int, epochs: int, seed: int, visit: Column, buy: Column) -> DataFrame:
    """Per run and epoch: customers that visited, offers shown to them, purchases, and the share bought.

    `offers` has customer_id and slot; a customer visits an epoch with probability `visit` and buys a shown offer with
    probability `buy` (expressions over its columns and epoch). Sums combine before the shuffle.
    """
    shown = replicate(offers, runs, epochs).where(draw(seed, "run", "epoch", "customer_id") < visit)
    bought = shown.withColumn("bought", (draw(seed + 1, "run", "epoch", "customer_id", "slot") < buy).cast("int")).withColumn("first", (F.col("slot") == 1).cast("int"))
    sums = bought.groupBy("run", "epoch").agg(F.sum("first").alias("visitors"), F.count(F.lit(1)).alias("shown"), F.sum("bought").alias("purchases"))
    return sums.withColumn("share", ratio(F.col("purchases"), F.col("shown")))
