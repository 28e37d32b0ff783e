"""Long-tail products that resemble the best sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.scalar import clip, dot
from aislewise.operators.vectors import mean_vectors, normalised, top_k_cosine
from aislewise.staging import stage

#: Weights of cosine, category, price, brand and discount in the score; the factor from a response to
#: discounts to one of volumes, that response where a category has none, the least that counts, the least and largest
#: discount, the quantile of tier 2's units to be reached, and the months that units and revenue cover.
WEIGHTS = (0.2, 0.2, 0.2, 0.2, 0.2)
VOLUME_FACTOR, USUAL_RESPONSE, LEAST_RESPONSE, LEAST_DISCOUNT, MOST_DISCOUNT, ENTRY, MONTHS = 7.0, 0.75, 0.01, 0.05, 0.50, 0.25, 12


def lookalikes(vectors: DataFrame, tiers: DataFrame, products: DataFrame, responses: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Tier-4 products: cosine to the centroid of tier 1, nearest tier-1 product, price ratio, shared category and brand, discount to break in, monthly sales, score.

    `vectors` has (product_id, vector), `tiers` (product_id, tier, units, revenue), `responses` (category, strength): the
    mean size of the category's response to discounts. The discount to break in is what lifts a product's units to the
    first quartile of tier 2. Products without a vector have no row; the nearest one is found by a blocked search, ties
    going to the smaller id. Results enter the score as they are rounded.
    """
    tiers = stage(tiers.select("product_id", "tier", "units", "revenue"), "tiers")  # catalogue-sized, read several times
    known = vectors.join(tiers, "product_id")
    top = known.where("tier = 1").select("product_id", "vector")
    tail = known.where("tier = 4").select("product_id", "vector")
    centroid = mean_vectors(top, None, "vector", at_unit_length=True).select(F.col("vector").alias("centroid"))
    near = top_k_cosine(tail, top, "product_id", "vector", 1).select(F.col("query_id").alias("product_id"), F.col("id").alias("nearest"), F.col("score").alias("similarity"))
    facts = products.select("product_id", "category", "brand", "price")
    first = top.select("product_id").join(facts, "product_id")
    categories = first.select(F.col("category").alias("c1")).where("c1 IS NOT NULL").distinct()
    brands = first.select(F.col("brand").alias("b1")).where("b1 IS NOT NULL").distinct()
    nearest = products.select(F.col("product_id").alias("nearest"), F.col("price").alias("nearest_price"), F.col("name").alias("nearest_name"))
    strengths = responses.where("category IS NOT NULL").select(F.col("category").alias("c2"), "strength")
    goal = tiers.agg(F.coalesce(F.expr(f"percentile(CASE WHEN tier = 2 THEN units END, {ENTRY}D)"), F.expr("percentile(units, 0.5D)")).alias("goal"))
    joined = (
        normalised(tail, "product_id", "vector").crossJoin(F.broadcast(centroid)).crossJoin(F.broadcast(goal))  # one row each
        .join(near, "product_id").join(facts, "product_id").join(tiers.select("product_id", "units", "revenue"), "product_id").join(nearest, "nearest", "left")
        .join(categories, F.col("category") == F.col("c1"), "left").join(brands, F.col("brand") == F.col("b1"), "left").join(strengths, F.col("category") == F.col("c2"), "left")
    )
    cosine = F.round(dot(F.col("vector"), F.col("centroid")), 4)
    price_ratio = F.round(F.col("price") / F.greatest(F.coalesce("nearest_price", "price"), F.lit(0.01)), 4)
    strength = F.coalesce("strength", F.lit(USUAL_RESPONSE))
    gap = F.col("goal") / F.nullif(F.col("units"), F.lit(0)).cast("double")
    needed = F.when(gap > 1, clip(F.ln(gap) / (strength * VOLUME_FACTOR), LEAST_DISCOUNT, MOST_DISCOUNT)).otherwise(LEAST_DISCOUNT)
    discount = F.when((F.col("units") > 0) & (strength > LEAST_RESPONSE), needed).otherwise(MOST_DISCOUNT)
    shaped = joined.select(
        "product_id", "category", "brand", cosine.alias("cosine"), "nearest", "nearest_name", F.round("similarity", 4).alias("similarity"), F.round(1 - F.col("similarity"), 4).alias("distance"),
        price_ratio.alias("price_ratio"), F.col("c1").isNotNull().cast("int").alias("same_category"), F.col("b1").isNotNull().cast("int").alias("same_brand"),
        F.round(discount, 4).alias("discount"), F.round(strength, 4).alias("strength"), F.bround(F.col("units") / F.lit(MONTHS)).cast("bigint").alias("monthly_units"),
        # to the cent, halves up, in whole numbers
        (F.floor((F.round(F.col("revenue") * 100).cast("bigint") * 2 + MONTHS) / F.lit(2 * MONTHS)) / 100).alias("monthly_revenue"),
    )
    a, b, c, d, e = weights
    near_price = F.greatest(F.lit(0.0), 1 - F.abs(F.col("price_ratio") - 1))
    score = a * F.col("cosine") + b * F.col("same_category") + c * F.coalesce(near_price, F.lit(0.0)) + d * F.col("same_brand") - e * F.col("discount")
    return shaped.withColumn("score", F.round(score, 4))
