"""Discount response: weighted least squares of log redemption rates per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.functions.scalar import clip, draw, money_sum, ratio

#: An offer of two for one, the cap on money off as a share of the price, the least rate whose logarithm is
#: taken, the largest discount, the organic share above which discounts are scaled down, and the sensitivity's terms.
TWO_FOR_ONE, MONEY_CAP, LEAST_RATE, MOST_DISCOUNT, MOSTLY_ORGANIC, ORGANIC_BASE, WEAK_RESPONSE = 0.5, 0.6, 1e-6, 0.5, 0.5, 0.3, 0.1
#: What may be left of an exact fit after rounding.
NO_ERROR = 1e-15


def capped_discount(kind: str, value: str, price: str, cap: float, other: float) -> Column:
    """An offer as a fraction of the price, capped; two for one is a half; unknown kinds count as `other`."""
    share = F.col(value) / F.nullif(F.col(price), F.lit(0.0))
    return F.when(F.col(kind) == "percent_off", F.least(F.col(value), F.lit(cap))).when(F.col(kind) == "bogo", TWO_FOR_ONE).when(F.col(kind) == "dollar_off", F.least(share, F.lit(cap))).otherwise(other)


def effective_discount(kind: str, value: str, price: str, cap: float = MONEY_CAP) -> Column:
    """The same for the response curve: percentages as they stand, unknown kinds too."""
    share = F.col(value) / F.nullif(F.col(price), F.lit(0.0))
    return F.when(F.col(kind) == "dollar_off", F.least(share, F.lit(cap))).when(F.col(kind) == "bogo", TWO_FOR_ONE).otherwise(F.col(value))


def response_levels(clips: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, category, level, clips, redeemed): clips by product and discount rounded to whole percents."""
    priced = clips.join(products.select("product_id", "category", "price"), "product_id")
    level = F.round(effective_discount("discount_type", "discount_value", "price").cast("decimal(18,6)"), 2).cast("double")
    return priced.groupBy("product_id", "category", level.alias("level")).agg(F.count(F.lit(1)).alias("clips"), F.sum(F.when(F.col("redeemed"), 1).otherwise(0)).alias("redeemed"))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail probability of Student's t: the regularised incomplete beta function at dof / (dof + t^2)."""
    x = (dof / (dof + t * t)).to_numpy(float)
    return pd.Series(incomplete_beta(dof.to_numpy(float) / 2, np.full(len(x), 0.5), x))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where that converges fast."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        logs = np.array([lgamma(i + j) - lgamma(i) - lgamma(j) if np.isfinite(i + j) and i > 0 else np.nan for i, j in zip(p, q, strict=True)])
        front = np.exp(logs + p * np.log(y) + q * np.log1p(-y)) / p
        f = c = np.ones_like(y)
        d = np.zeros_like(y)
        for k in range(400):
            m = k // 2
            if k == 0:
                term = np.ones_like(y)
            elif k % 2 == 0:
                term = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            else:
                term = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / _away(1 + term * d)
            c = _away(1 + term / c)
            f = f * c * d
        result = front * (f - 1)
    result = np.where(y <= 0, 0.0, result)
    return np.where(flip, 1 - result, result)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-30, 1e-30, x)


def weighted_slopes(points: DataFrame, key: str, x: str, y: str, weight: str) -> DataFrame:
    """(key, points, beta, se, p_value) of y on x within each key, by weighted moments around the weighted means.

    Keys with fewer than two distinct x have no row. With two points the fit is exact: se and p_value are NULL.
    """
    w = F.col(weight).cast("double")
    means = points.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.count_distinct(x).alias("xs"), (F.sum(w * F.col(x)) / F.sum(w)).alias("mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("my"))
    means = means.where("xs >= 2")
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    sums = points.join(means, key).groupBy(key, "points").agg(F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"))
    beta = F.col("sxy") / F.col("sxx")
    dof = F.greatest(F.col("points") - 2, F.lit(1))
    error = F.col("syy") - beta * F.col("sxy")
    error = F.when(error > NO_ERROR, error).otherwise(0.0)
    se = F.when(F.col("points") > 2, F.sqrt(error / dof / F.col("sxx")))
    fitted = sums.select(key, "points", beta.alias("beta"), se.alias("se"), dof.cast("double").alias("dof"))
    return fitted.withColumn("p_value", F.when(F.col("se") > 0, t_two_sided(F.col("beta") / F.col("se"), F.col("dof")))).drop("dof")


def response_points(levels: DataFrame, keys: Sequence[str], least_clips: int, least_total: int = 0) -> DataFrame:
    """(keys, level, clips, rate, log_rate): levels with enough clips and any redemption, of keys with enough clips in all."""
    summed = levels.groupBy(*keys, "level").agg(F.sum("clips").alias("clips"), F.sum("redeemed").alias("redeemed"))
    rate = ratio(F.col("redeemed"), F.col("clips"))
    points = summed.where((F.col("clips") >= least_clips) & (F.col("redeemed") > 0) & F.col("level").isNotNull()).select(*keys, "level", "clips", rate.alias("rate"), F.ln(F.greatest(rate, F.lit(LEAST_RATE))).alias("log_rate"))
    if least_total:
        enough = levels.groupBy(*keys).agg(F.sum("clips").alias("t")).where(F.col("t") >= least_total).select(*keys)
        points = points.join(enough, list(keys), "left_semi")
    return points


def organic_strength(tx: DataFrame, features: DataFrame | None = None, key: str = "transaction_id", share: float = 1.0, seed: int = 42) -> DataFrame:
    """(product_id, organic_ratio, discount_ratio, revenue, units, redemption_rate, clips) from product features or, without them, from purchases.

    `share` takes a sample of the purchases, drawn by `key`: the same rows in every run.
    """
    if features is not None:
        return features.select("product_id", "organic_ratio", (1 - F.col("organic_ratio")).alias("discount_ratio"), "revenue", "units", F.coalesce("redemption_rate", F.lit(0.0)).alias("redemption_rate"), F.coalesce("clips", F.lit(0)).cast("bigint").alias("clips"))
    rows = tx if share >= 1 else tx.where(draw(seed, key) < share)
    off = F.coalesce("discount_pct", F.lit(0.0))
    return rows.groupBy("product_id").agg(
        ratio(F.count(F.when(off == 0, 1)), F.count(F.lit(1))).alias("organic_ratio"), ratio(F.count(F.when(off > 0, 1)), F.count(F.lit(1))).alias("discount_ratio"),
        money_sum("subtotal").alias("revenue"), F.sum("quantity").alias("units"), F.lit(0.0).alias("redemption_rate"), F.lit(0).cast("bigint").alias("clips"),
    )


def with_fallback(products: DataFrame, by_product: DataFrame, by_category: DataFrame) -> DataFrame:
    """(product_id, category, beta, source): a product's own slope, else its category's, else 0."""
    own = by_product.select("product_id", F.col("beta").alias("b1"))
    other = by_category.select("category", F.col("beta").alias("b2"))
    source = F.when(F.col("b1").isNotNull(), "product").when(F.col("b2").isNotNull(), "category").otherwise("none")
    return products.select("product_id", "category").join(own, "product_id", "left").join(other, "category", "left").select("product_id", "category", F.coalesce("b1", "b2", F.lit(0.0)).alias("beta"), source.alias("source"))


def best_discount(beta: Column, organic: Column, most: float = MOST_DISCOUNT) -> Column:
    """The discount that maximises (1 - d) exp(beta d) on [0, most], scaled down where more than half of the sales are organic.

    The derivative has the sign of beta - 1 - beta d: the optimum is 1 - 1 / beta above 1 and 0 at 1 or below.
    """
    found = F.when(beta > 1, clip(1 - 1 / F.nullif(beta, F.lit(0.0)), 0.0, most)).otherwise(0.0)
    return F.when(organic > MOSTLY_ORGANIC, found * 2 * (1 - organic)).otherwise(found)


def revenue_at(price: Column, units: Column, beta: Column, discount: Column) -> Column:
    return price * F.greatest(units.cast("double"), F.lit(1.0)) * (1 - discount) * F.exp(beta * discount)


def sensitivity(beta: Column, organic: Column) -> Column:
    return F.when(organic > MOSTLY_ORGANIC, -(organic - ORGANIC_BASE) * (1 + F.abs(beta))).when(beta > 0, beta * (1 - organic)).otherwise(WEAK_RESPONSE * beta)
