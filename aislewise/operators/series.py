"""Series over epochs: bands, streaks, convergence, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.scalar import ratio


def bands(df: DataFrame, epoch: str, value: str) -> DataFrame:
    """Per epoch: runs, mean, population deviation and the 95% band around the mean."""
    stats = df.groupBy(epoch).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    half = 1.96 * F.col("std") / F.sqrt("runs")
    return stats.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def first_streak(df: DataFrame, entity: str, epoch: str, hit: str, length: int) -> DataFrame:
    """(entity, epoch): where an entity first completes `length` successive epochs with `hit`, one row per epoch given."""
    by = Window.partitionBy(entity).orderBy(epoch)
    island = df.withColumn("__island", F.sum(F.when(F.col(hit), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = island.where(F.col(hit)).withColumn("__run", F.row_number().over(Window.partitionBy(entity, "__island").orderBy(epoch)))
    return run.where(F.col("__run") == length).groupBy(entity).agg(F.min(epoch).alias(epoch))


def converged_at(df: DataFrame, epoch: str, variation: str, window: int, below: float) -> DataFrame:
    """One row: the first epoch before which `window` epochs all had a variation below the limit; NULL if none."""
    before = Window.orderBy(epoch).rowsBetween(-window, -1)  # one row per epoch
    marked = df.withColumn("__most", F.max(variation).over(before)).withColumn("__n", F.count(F.lit(1)).over(before))
    return marked.where((F.col("__n") == window) & (F.col("__most") < below)).agg(F.min(epoch).alias("converged_at"))


def filled_running_total(df: DataFrame, epoch: str, value: str, first: int, last: int, entity: str | None = None) -> DataFrame:
    """(entity, epoch, value, running): per entity, if one is given, every epoch from first to last, absent ones with 0, and the running total."""
    keys = [entity, epoch] if entity else [epoch]
    sums = df.groupBy(*keys).agg(F.sum(value).alias(value))
    every = F.explode(F.sequence(F.lit(first), F.lit(last)).cast(f"array<{df.schema[epoch].dataType.simpleString()}>")).alias(epoch)
    spine = sums.select(entity).distinct().select(entity, every) if entity else df.sparkSession.range(1).select(every)
    if entity:
        spine, sums = spine.where(F.col(entity).isNotNull()), sums.where(F.col(entity).isNotNull())
    by = (Window.partitionBy(entity) if entity else Window.partitionBy()).orderBy(epoch)  # without an entity: one row per epoch
    return spine.join(sums, keys, "left").na.fill(0, [value]).withColumn("running", F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_and_last(df: DataFrame, epoch: str, values: list[str], steady_below: float) -> DataFrame:
    """(metric, first_mean, last_mean, last_std, variation, change, steady_at): each value over the runs of the first epoch against those of the last.

    `steady_at` is the first epoch whose deviation is below that share of its mean; NULL if there is none.
    """
    long = df.select(epoch, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values))).alias("m")).select(epoch, "m.*")
    stats = long.groupBy("metric", epoch).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    steady = F.when(F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)) < steady_below, F.col(epoch))
    ends = stats.groupBy("metric").agg(F.min_by("mean", epoch).alias("first_mean"), F.max_by("mean", epoch).alias("last_mean"), F.max_by("std", epoch).alias("last_std"), F.min(steady).alias("steady_at"))
    return ends.withColumns({"variation": ratio(F.col("last_std"), F.col("last_mean")), "change": ratio(F.col("last_mean"), F.col("first_mean")) - 1})
