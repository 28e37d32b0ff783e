"""Analytic views over the purchase table.

Distinct counts go through pairs of group and value first, so a group with a large share of the rows is spread by value
and merged from partial results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.scalar import money_sum, ratio


def customer_summary(tx: DataFrame) -> DataFrame:
    """Per customer_id (NULL is a group): rows, distinct products and stores, spend, average, first and last day."""
    by_pair = tx.groupBy("customer_id", "product_id", "store_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("total").alias("priced"), F.sum(F.col("total").cast("decimal(18,2)")).alias("spend"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    return by_pair.groupBy("customer_id").agg(
        F.sum("n").alias("transactions"), F.count_distinct("product_id").alias("products"), F.count_distinct("store_id").alias("stores"),
        F.sum("spend").cast("double").alias("spend"), ratio(F.sum("spend"), F.sum("priced")).alias("average"), F.min("first").alias("first_day"), F.max("last").alias("last_day"),
    )


def monthly_sales(tx: DataFrame) -> DataFrame:
    return tx.groupBy("product_id", F.trunc("date", "MM").alias("month")).agg(F.sum("quantity").alias("units"), money_sum("total").alias("revenue"))


def store_performance(tx: DataFrame) -> DataFrame:
    by_customer = tx.groupBy("store_id", "customer_id").agg(F.count(F.lit(1)).alias("n"), F.count("total").alias("priced"), F.sum(F.col("total").cast("decimal(18,2)")).alias("spend"))
    return by_customer.groupBy("store_id").agg(
        F.count("customer_id").alias("customers"), F.sum("n").alias("transactions"), F.sum("spend").cast("double").alias("revenue"), ratio(F.sum("spend"), F.sum("priced")).alias("average")
    )


def customer_product_matrix(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("purchases"), money_sum("total").alias("spent"), F.max("date").alias("last_day"))


_LONG, _BLOCK, _STRIPE = 24, 16_384, 512
#: Cells of a count matrix of long baskets (32 MB).
_CELLS = 1 << 22


def co_purchase(tx: DataFrame) -> DataFrame:
    """(product_a, product_b, co_purchases), a < b: pairs of rows of one customer on one day, as a self join would count them.

    Rows with NULL in customer_id, date or product_id match nothing. A task works on blocks of baskets: pairs of short
    baskets are counted by hashing, long baskets by products of their count matrix, stripe by stripe, so that no
    basket's pairs are written out; only sums per pair leave a task.
    """
    lines = tx.where("customer_id IS NOT NULL AND date IS NOT NULL AND product_id IS NOT NULL").groupBy("customer_id", "date", F.col("product_id").cast("bigint").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    baskets = lines.groupBy("customer_id", "date").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("x")).where(F.size("x") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                p, n = (whole.slice(at, _BLOCK).column(i) for i in (0, 1))
                basket = np.repeat(np.arange(len(p)), np.diff(p.offsets.to_numpy()))
                ids, code = np.unique(p.flatten().to_numpy(), return_inverse=True)
                for a, b, c in _pairs(basket, code, n.flatten().to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(c.astype(np.int64))], names=["product_a", "product_b", "n"])

    return (
        baskets.select(F.col("x.p").alias("p"), F.col("x.n").alias("n"))
        .mapInArrow(run, "product_a bigint, product_b bigint, n bigint")
        .groupBy("product_a", "product_b")
        .agg(F.sum("n").alias("co_purchases"))
    )


def _pairs(basket: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, sum of products of counts), a < b, of rows sorted by basket and code."""
    size = np.bincount(basket)
    long = size[basket] > _LONG
    sb, sc, sn, width = basket[~long], code[~long], n[~long], int(code.max(initial=0)) + 1
    keys, weights = [], []
    for step in range(1, _LONG):
        same = np.flatnonzero(sb[step:] == sb[:-step]) if len(sb) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        keys.append(sc[same] * width + sc[same + step])
        weights.append(sn[same] * sn[same + step])
    if keys:
        pair, back = np.unique(np.concatenate(keys), return_inverse=True)
        yield pair // width, pair % width, np.bincount(back, np.concatenate(weights))
    if long.any():
        ids, of = np.unique(basket[long], return_inverse=True)
        lc, ln = code[long], n[long]
        step = max(1, _CELLS // len(np.unique(lc)))
        for first in range(0, len(ids), step):
            some = (of >= first) & (of < first + step)
            own, column = np.unique(lc[some], return_inverse=True)
            matrix = np.zeros((min(step, len(ids) - first), len(own)))
            matrix[of[some] - first, column] = ln[some]
            for at in range(0, len(own), _STRIPE):
                product = np.triu(matrix[:, at : at + _STRIPE].T @ matrix[:, at:], 1)
                i, j = np.nonzero(product)
                if len(i):
                    yield own[at + i], own[at + j], product[i, j]
