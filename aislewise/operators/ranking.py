"""Re-ranking of scored candidates under recency, coupon and category rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places, places per category, candidates per place, weight of the margin, factors for recent and clipped products.
PLACES, PER_CATEGORY, POOL, MARGIN_WEIGHT, RECENT_FACTOR, CLIPPED_FACTOR = 10, 3, 5, 0.3, 0.5, 1.15


def last_products(tx: DataFrame, n: int) -> DataFrame:
    """(customer_id, product_id, last_day, place): each customer's n products bought last, of one day the smaller id first.

    Rows are combined per (customer, product) before the window, whose limit also applies before the shuffle.
    """
    pairs = tx.where("customer_id IS NOT NULL AND product_id IS NOT NULL AND date IS NOT NULL").groupBy("customer_id", "product_id").agg(F.max("date").alias("last_day"))
    by = Window.partitionBy("customer_id").orderBy(F.col("last_day").desc(), "product_id")
    return pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def clipped_products(clips: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct (customer_id, product_id) of clips, by card number; clips are made distinct before the join."""
    cards = clips.select("loyalty_number", "product_id").distinct()
    return cards.join(customers.select("loyalty_number", F.col("customer_id").cast("bigint").alias("customer_id")), "loyalty_number").select("customer_id", "product_id").distinct()


def adjusted(scores: DataFrame, recent: DataFrame, clipped: DataFrame, recent_factor: float, clipped_factor: float) -> DataFrame:
    """(customer_id, product_id, score): scores multiplied where the pair is in one of two sparse sets of pairs, which have each pair once."""
    key = ["customer_id", "product_id"]
    flagged = scores.join(recent.select(*key, F.lit(True).alias("__r")), key, "left").join(clipped.select(*key, F.lit(True).alias("__c")), key, "left")
    factor = F.when(F.col("__r"), recent_factor).otherwise(1.0) * F.when(F.col("__c"), clipped_factor).otherwise(1.0)
    return flagged.withColumn("score", F.col("score") * factor).drop("__r", "__c")


def constrained_top(
    candidates: DataFrame, recent: DataFrame, clipped: DataFrame, n: int = PLACES, per_category: int = PER_CATEGORY, pool: int = POOL, margin_weight: float = MARGIN_WEIGHT, recent_factor: float = RECENT_FACTOR, clipped_factor: float = CLIPPED_FACTOR
) -> DataFrame:
    """(customer_id, product_id, category, score, final, place): n products per customer with at most per_category of a category.

    A score is raised by the margin, multiplied by recent_factor and clipped_factor where the pair is in those sets, and
    the n * pool best are walked in falling order. Walking with a quota equals numbering within (customer, category) and
    then within the customer. Of equal scores the smaller product comes first; NULL and NaN scores take no part; a pair
    counts once with its best score.
    """
    key = ["customer_id", "product_id"]
    base = candidates.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    base = base.groupBy(*key).agg(F.max_by(F.struct("score", "category", "margin"), F.struct("score", "margin", "category")).alias("b")).select(*key, "b.*")
    flagged = base.join(recent.select(*key, F.lit(True).alias("__r")), key, "left").join(clipped.select(*key, F.lit(True).alias("__c")), key, "left")
    final = F.col("score").cast("double") * (1 + F.coalesce(F.col("margin").cast("double"), F.lit(0.0)) * margin_weight)
    final = final * F.when(F.col("__r"), recent_factor).otherwise(1.0) * F.when(F.col("__c"), clipped_factor).otherwise(1.0)
    order = [F.col("final").desc(), F.col("product_id")]
    pooled = flagged.withColumn("final", final).withColumn("__p", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))).where(F.col("__p") <= n * pool)
    quota = pooled.withColumn("__q", F.row_number().over(Window.partitionBy("customer_id", "category").orderBy(*order))).where(F.col("__q") <= per_category)
    placed = quota.withColumn("place", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))).where(F.col("place") <= n)
    return placed.select(*key, "category", F.col("score").cast("double").alias("score"), "final", "place")
