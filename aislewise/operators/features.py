"""Product and customer features, and tiers from thresholds over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.scalar import bucket, margin, money_sum, ratio, share_sum
from aislewise.operators.skew import exact_ranks
from aislewise.staging import stage

#: Rules of the coupon tiers (shares of the catalogue, redemption rate, margin) and of the revenue tiers
#: (ranks, repeat rate, shares of discounted and undiscounted rows), and the cut points of price sensitivity.
FEW, MANY, HALF = 0.3, 0.7, 0.5
REDEEMED, HIGH_MARGIN = 0.40, 0.45
CORE_RANK, REPEAT_RANK, REPEAT_RATE, DISCOUNTED, ORGANIC, LOW_UNITS = 12, 50, 0.3, 0.5, 0.7, 0.25
SENSITIVITY_CUTS = (0.05, 0.10, 0.15, 0.20)


def redeemed_rows(column: str = "redeemed") -> Column:
    return F.sum(F.when(F.col(column), 1).otherwise(0))


def product_features(tx: DataFrame, clips: DataFrame, products: DataFrame) -> DataFrame:
    """One row per product: catalogue columns, margin, sales and coupon figures, organic share. Both fact tables are aggregated before the join."""
    pairs = tx.groupBy("product_id", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("total").cast("decimal(18,2)")).alias("total"), F.sum(F.col("discount_pct").cast("decimal(18,4)")).alias("d"), F.count("discount_pct").alias("dn")
    )
    sold = pairs.groupBy("product_id").agg(
        F.sum("n").alias("units"), F.sum("total").cast("double").alias("revenue"), F.count("customer_id").alias("buyers"), ratio(F.sum("d"), F.sum("dn")).alias("avg_discount")
    )
    held = clips.groupBy("product_id").agg(F.count(F.lit(1)).alias("clips"), redeemed_rows().alias("redeemed"))
    zero = F.lit(0)
    buyers, redeemed, clipped = (F.coalesce(c, zero) for c in ("buyers", "redeemed", "clips"))
    return (
        products.select("product_id", "name", "brand", "category", "price", "unit_cost", "is_store_brand", "is_rx", "popularity_score")
        .join(sold, "product_id", "left")
        .join(held, "product_id", "left")
        .select(
            "product_id", "name", "brand", "category", "price", "unit_cost", "is_store_brand", "is_rx", "popularity_score", margin(F.col("price"), F.col("unit_cost")).alias("margin"),
            F.coalesce("units", zero).alias("units"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"), buyers.alias("buyers"), F.coalesce("avg_discount", F.lit(0.0)).alias("avg_discount"),
            clipped.alias("clips"), redeemed.alias("redeemed"), F.coalesce(ratio(F.col("redeemed"), F.col("clips")), F.lit(0.0)).alias("redemption_rate"),
            F.when(buyers > 0, ratio(buyers - redeemed, buyers)).otherwise(1.0).alias("organic_ratio"), F.when(buyers > 0, ratio(clipped, buyers)).otherwise(0.0).alias("clip_rate"),
        )
    )


def customer_features(tx: DataFrame, clips: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per customer: spend, baskets, coupon use and a price-sensitivity bucket. Clips are aggregated by card before they meet customers."""
    bought = tx.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("transactions"), money_sum("total").alias("spend"), F.count("total").alias("priced"), share_sum("discount_pct").alias("d"), F.count("discount_pct").alias("dn")
    )
    by_card = clips.groupBy("loyalty_number").agg(F.count(F.lit(1)).alias("clips"), redeemed_rows().alias("redeemed"))
    people = customers.select(F.col("customer_id").cast("bigint").alias("customer_id"), "loyalty_number", "age", "gender", "state", "is_student")
    n, c, r = (F.coalesce(x, F.lit(0)) for x in ("transactions", "clips", "redeemed"))
    return (
        people.join(bought, "customer_id", "left").join(by_card, "loyalty_number", "left").select(
            "customer_id", "loyalty_number", "age", "gender", "state", "is_student", F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce(ratio(F.col("spend"), F.col("priced")), F.lit(0.0)).alias("avg_basket"),
            n.alias("transactions"), c.alias("clips"), r.alias("redeemed"), F.when(c > 0, ratio(r, c)).otherwise(0.0).alias("redemption_rate"), F.when(n > 0, ratio(c, n)).otherwise(0.0).alias("engagement"),
            bucket(F.coalesce(ratio(F.col("d"), F.col("dn")), F.lit(0.0)), SENSITIVITY_CUTS).alias("sensitivity"),
        )
    )


def with_quantiles(df: DataFrame, columns: Mapping[str, tuple[str, float]]) -> DataFrame:
    """df with the same quantile columns on each row, from exact continuous percentiles of a catalogue-sized table."""
    cuts = df.agg(*(F.expr(f"percentile(`{c}`, {p}D)").alias(name) for name, (c, p) in columns.items()))
    return df.crossJoin(F.broadcast(cuts))  # one row


def large_quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """One row of exact continuous percentiles of a column of any size: the two ranks around each are found by exact_ranks."""
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in probabilities.items()}
    wanted = F.array_distinct(F.array(*(x.cast("bigint") for p in at.values() for x in (F.floor(p) + 1, F.ceil(p) + 1))))
    values = stage(df.select(F.lit(1).alias("__all"), F.col(value).alias("__v")), "values")  # read once per round
    ranked = exact_ranks(values, "__all", "__v", wanted)
    low = {name: F.max(F.when(F.col("rank") == F.floor(p) + 1, F.col("__v"))) for name, p in at.items()}
    high = {name: F.max(F.when(F.col("rank") == F.ceil(p) + 1, F.col("__v"))) for name, p in at.items()}
    return ranked.groupBy("n").agg(*((low[k] + (high[k] - low[k]) * (p - F.floor(p))).alias(k) for k, p in ((k, F.first(v)) for k, v in at.items()))).drop("n")


def coupon_tiers(features: DataFrame) -> DataFrame:
    """Product features with a tier by clips, redemption, units and margin against quantiles of the catalogue; the first rule that holds decides."""
    cut = with_quantiles(features, {"c30": ("clips", FEW), "c70": ("clips", MANY), "u50": ("units", HALF), "u70": ("units", MANY)})
    tier = (
        F.when((F.col("clips") >= F.col("c70")) & (F.col("redemption_rate") >= REDEEMED), "coupon_loyalist")
        .when((F.col("clips") >= F.col("c30")) & (F.col("redemption_rate") < REDEEMED), "coupon_curious")
        .when((F.col("units") >= F.col("u70")) & (F.col("clips") < F.col("c30")), "organic_star")
        .when((F.col("margin") >= HIGH_MARGIN) & (F.col("units") < F.col("u50")), "hidden_gem")
        .otherwise("unclassified")
    )
    return cut.withColumn("tier", tier).drop("c30", "c70", "u50", "u70")


def repeated() -> Column:
    """The share of a group's pairs (of product and customer, with their rows n) that have two rows or more."""
    return ratio(F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)), F.count(F.lit(1)))


def repeat_rates(tx: DataFrame) -> DataFrame:
    """Per product, the share of its customers with two purchases or more."""
    pairs = tx.groupBy("product_id", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("product_id").agg(repeated().alias("repeat_rate"))


def basket_sizes(tx: DataFrame) -> DataFrame:
    """Per product, the mean size of the baskets its rows are in. Sizes come from counts per basket and product, so each basket is one small group."""
    rows = tx.where("customer_id IS NOT NULL AND date IS NOT NULL").groupBy("customer_id", "date", "product_id").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.withColumn("size", F.sum("n").over(Window.partitionBy("customer_id", "date")))
    return sized.groupBy("product_id").agg(ratio(F.sum(F.col("n") * F.col("size")), F.sum("n")).alias("basket_size"))


def revenue_tiers(tx: DataFrame, discounted_above: float = 0.0) -> DataFrame:
    """Products ranked by revenue and put into tiers 1 to 4 by rank, repeat rate, discount and organic shares and units."""
    pairs = tx.where("product_id IS NOT NULL").groupBy("product_id", "customer_id").agg(
        F.sum("quantity").alias("q"), F.sum(F.col("subtotal").cast("decimal(18,2)")).alias("r"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.coalesce("discount_pct", F.lit(0.0)) > discounted_above, 1).otherwise(0)).alias("d"),
    )
    base = pairs.groupBy("product_id").agg(
        F.sum("q").alias("units"), F.coalesce(F.sum("r").cast("double"), F.lit(0.0)).alias("revenue"), F.count("customer_id").alias("customers"),
        ratio(F.sum("d"), F.sum("n")).alias("discounted"), ratio(F.sum("n") - F.sum("d"), F.sum("n")).alias("organic"), repeated().alias("repeat_rate"),
    )
    whole = base.join(basket_sizes(tx), "product_id", "left").na.fill({"basket_size": 1.0})
    whole = whole.select(*(c for c in whole.columns if c not in ("repeat_rate", "basket_size")), "repeat_rate", "basket_size")
    ranked = whole.withColumn("revenue_rank", F.rank().over(Window.orderBy(F.col("revenue").desc())))  # one row per product: small
    cut = with_quantiles(ranked, {"u50": ("units", HALF), "u25": ("units", LOW_UNITS)})
    tier = (
        F.when((F.col("revenue_rank") <= CORE_RANK) | ((F.col("revenue_rank") <= REPEAT_RANK) & (F.col("repeat_rate") > REPEAT_RATE)), 1)
        .when((F.col("discounted") > DISCOUNTED) & (F.col("units") > F.col("u50")), 2)
        .when((F.col("organic") > ORGANIC) & (F.col("units") > F.col("u25")), 3)
        .otherwise(4)
    )
    return cut.withColumn("tier", tier).drop("u50", "u25")


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, id): ids from 1 in rising order of the distinct values that aren't NULL; 0 stays for unknown ones."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("id", F.row_number().over(Window.orderBy("value")))
