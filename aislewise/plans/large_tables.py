"""Queries on skewed keys (p2), per-entity features (p5) and trailing periods (p6).

The stores of the feature queries persist below the folder named by the setting `spark.aislewise.features`, and a later
run recomputes only what has changed; where it is unset, they live as long as the session.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.feature_store import Events, FeatureStore, clean_number
from aislewise.operators.rolling import trailing_totals
from aislewise.operators.skew import frequent_keys, key_quantiles, key_totals, skew_join
from aislewise.staging import new_path
from aislewise.tables import table, version

#: The categories and kinds of discount in the test tables, for the SQL; the query takes them from the data.
CATEGORIES = (
    "allergy", "baby", "beverages", "cosmetics", "cough & cold", "digestive", "first aid", "hair care", "household", "none", "oral care", "pain relief", "pharmacy", "skin care", "snacks", "vitamins",
)
DISCOUNTS = ("percent_off", "dollar_off", "bogo")
MAX_TYPES = 2000
TXN = Events(entity="customer_id", time="date", once="transaction_id", amount="cents")
CLIP = Events(entity="number", time="clip_date", once="clip_id", types=("discount_type", "category", "redeemed"))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_keys(table(spark, sf_dir, "transactions", "customer_id", "product_id"), ["customer_id", "product_id"], 0.02).select("field", "key_id")


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "transactions", "transaction_id", "customer_id", "product_id", "total")
    return key_totals(rows, ["customer_id", "product_id"], "transaction_id", cents("total")).withColumnsRenamed({"items": "lines", "total": "total_cents"})


def p2_product_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_quantiles(table(spark, sf_dir, "transactions", "product_id", "total"), "product_id", "total", [0.1, 0.5, 0.9, 0.99])


def p2_customer_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_quantiles(table(spark, sf_dir, "transactions", "customer_id", "total"), "customer_id", "total", [0.1, 0.5, 0.9, 0.99])


def p2_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "transactions", "transaction_id", "customer_id", "product_id", "total")
    people = table(spark, sf_dir, "customers").select(F.col("customer_id").cast("bigint").alias("customer_id"), "age", F.col("loyalty_number").alias("card"))
    return skew_join(rows, people, "customer_id").select("transaction_id", "customer_id", "product_id", "total", "age", "card")


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transactions").select("customer_id", "date", "transaction_id", cents("total").alias("cents"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.replace(F.lower(F.trim("category")), F.lit(" and "), F.lit(" & "))
    products = table(spark, sf_dir, "products").select("product_id", F.coalesce(category, F.lit("none")).alias("category"))
    clips = table(spark, sf_dir, "coupon_clips").select(
        clean_number("loyalty_number").alias("number"), "clip_date", "clip_id", F.coalesce(F.lower(F.trim("discount_type")), F.lit("no kind")).alias("discount_type"), F.coalesce("redeemed", F.lit(False)).alias("redeemed"), "product_id"
    )
    return clips.join(products, "product_id", "left").withColumn("category", F.coalesce("category", F.lit("none"))).drop("product_id")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customers").select(F.col("customer_id").cast("bigint").alias("customer_id"), clean_number("loyalty_number").alias("number"))


def _store(spark: SparkSession, sf_dir: str, name: str, events: Events, sources: Sequence[str], *states: DataFrame) -> FeatureStore:
    """The store of that name, brought up to each of the given states of its events in turn."""
    kept = spark.conf.get("spark.aislewise.features", None)
    store = FeatureStore(spark, f"{kept.rstrip('/')}/{name}" if kept else new_path(spark, "features"), events)
    for i, rows in enumerate(states):
        store.update(rows, f"{version(spark, sf_dir, *sources)} {i}" if kept else None)
    return store


def _bought(spark: SparkSession, sf_dir: str) -> FeatureStore:
    return _store(spark, sf_dir, "transactions", TXN, ["transactions"], _transactions(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "coupon_clips").select(clean_number("loyalty_number").alias("number"), "clip_date", "clip_id", F.coalesce("redeemed", F.lit(False)).alias("redeemed"))
    store = _store(spark, sf_dir, "redeemed", Events("number", "clip_date", "clip_id", ("redeemed",)), ["coupon_clips"], clips)
    redeemed = store.merged(clips).where("redeemed").select(F.col("entity").alias("number"), "n")
    bought = _bought(spark, sf_dir).merged(_transactions(spark, sf_dir)).select(F.col("entity").alias("customer_id"))
    return _customers(spark, sf_dir).join(redeemed.where("n >= 2"), "number").join(bought, "customer_id", "left_anti").select("customer_id")


def _types(partials: DataFrame, *columns: str) -> list[dict[str, str]]:
    """The types of each column in the data, with a name for each; an error beyond MAX_TYPES, which no table has columns for."""
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(columns)))).alias("e")
    found = partials.select(entries).select("e.*").where("t IS NOT NULL").distinct().limit(MAX_TYPES + 1).collect()
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types; group them first")
    names: list[dict[str, str]] = [{} for _ in columns]
    for i, kind in sorted(found):
        name = _name(kind)
        while name in names[i].values():
            name += "_"
        names[i][kind] = name
    return names


def _features(people: DataFrame, bought: DataFrame, clipped: DataFrame, all_clipped: DataFrame, as_of: str) -> DataFrame:
    """One row per customer from merged partial aggregates, with columns for each type of clip in `all_clipped`."""
    day = F.lit(as_of).cast("date")
    t = bought.select(F.col("entity").alias("customer_id"), F.col("n").alias("purchases"), F.col("total").alias("spent_cents"), F.datediff(day, "last").alias("days_since_purchase"))
    discounts, categories = _types(all_clipped, "discount_type", "category")

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    c = clipped.groupBy(F.col("entity").alias("number")).agg(
        count(F.lit(True), "clips"), count(F.col("redeemed"), "redeemed"), F.datediff(day, F.max("last")).alias("days_since_clip"),
        *(count(F.col("discount_type") == d, f"clips_{n}") for d, n in discounts.items()), *(count(F.col("category") == k, f"clips_{n}") for k, n in categories.items()),
        *(count(F.col("redeemed") & (F.col("category") == k), f"redeemed_{n}") for k, n in categories.items()),
    )
    wide = people.join(t, "customer_id", "left").join(c, "number", "left").drop("number")
    return wide.na.fill(0, [x for x in wide.columns if not x.startswith("days_") and x != "customer_id"])


def _name(kind: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", kind.lower()).strip("_") or "blank"


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features over all events, as of the end of 2024."""
    bought = _bought(spark, sf_dir).merged(_transactions(spark, sf_dir))
    clips = _clips(spark, sf_dir)
    store = _store(spark, sf_dir, "clips", CLIP, ["coupon_clips", "products"], clips)
    return _features(_customers(spark, sf_dir), bought, store.merged(clips), store.stored(clips), "2024-12-31")


def p5_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of 2024-10-15 to 2024-12-20 from stores that saw the events up to June first and then all of them."""
    bought, clipped = _transactions(spark, sf_dir), _clips(spark, sf_dir)
    a = _store(spark, sf_dir, "transactions_twice", TXN, ["transactions"], bought.where("date < DATE '2024-07-01'"), bought)
    b = _store(spark, sf_dir, "clips_twice", CLIP, ["coupon_clips", "products"], clipped.where("clip_date < DATE '2024-07-01'"), clipped)
    period = "2024-10-15", "2024-12-20"
    return _features(_customers(spark, sf_dir), a.merged(bought, *period), b.merged(clipped, *period), b.stored(clipped), "2024-12-20")


def _trailing(spark: SparkSession, sf_dir: str, windows: list[int], above: dict[int, int] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "transactions", "customer_id", "date", "subtotal", "transaction_id")
    return trailing_totals(rows, "customer_id", "date", cents("subtotal"), dt.date(2024, 1, 1), dt.date(2024, 12, 31), windows, "transaction_id", above)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir, [7], {7: 30_000}).select("customer_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir, [7, 30]).withColumnsRenamed({"total_7": "cents_7", "average_7": "average_cents_7", "total_30": "cents_30", "average_30": "average_cents_30"})


QUERIES = {f.__name__: f for f in (p2_found, p2_totals, p2_product_quantiles, p2_customer_quantiles, p2_join, p5_found, p5_features, p5_recent, p6_found, p6_rolling)}

_NUMBER = "TRY_CAST(nullif(regexp_extract(regexp_replace(upper(translate({0}, '０１２３４５６７８９ＥＣｅｃ', '0123456789ECEC')), '[^0-9A-Z]', '', 'g'), '^(?:EC)?0*([0-9]{{1,10}})$', 1), '') AS BIGINT)"
_DAILY = """WITH t AS (SELECT DISTINCT transaction_id, customer_id, date, coalesce(CAST(round(subtotal * 100) AS BIGINT), 0) AS c FROM transactions
              WHERE customer_id IS NOT NULL AND date IS NOT NULL),
            s AS (SELECT customer_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT customer_id FROM t), range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 DAY) r(d)),
            a AS (SELECT customer_id, date, sum(c) AS c FROM t GROUP BY 1, 2),
            w AS (SELECT s.customer_id, s.day, sum(coalesce(c, 0)) OVER (PARTITION BY s.customer_id ORDER BY s.day ROWS 6 PRECEDING) AS c7,
              sum(coalesce(c, 0)) OVER (PARTITION BY s.customer_id ORDER BY s.day ROWS 29 PRECEDING) AS c30
              FROM s LEFT JOIN a ON a.customer_id = s.customer_id AND a.date = s.day)"""
_FEATURES = (
    """WITH p AS (SELECT CAST(customer_id AS BIGINT) AS customer_id, """ + _NUMBER.format("loyalty_number") + """ AS number FROM customers),
            t AS (SELECT customer_id, count(*) AS purchases, CAST(sum(coalesce(c, 0)) AS BIGINT) AS spent_cents, CAST(date_diff('day', max(date), DATE '{day}') AS INTEGER) AS dp FROM
              (SELECT DISTINCT transaction_id, customer_id, date, CAST(round(total * 100) AS BIGINT) AS c FROM transactions WHERE {tx}) GROUP BY 1),
            k AS (SELECT """.replace("{day}", "{day}") + _NUMBER.format("loyalty_number").replace("{1,10}", "{{1,10}}") + """ AS number, clip_id, max(clip_date) AS d, max(lower(trim(discount_type))) AS dt,
              max(coalesce(replace(lower(trim(category)), ' and ', ' & '), 'none')) AS cat, max(coalesce(redeemed, false)) AS red
              FROM coupon_clips LEFT JOIN products USING (product_id) WHERE {clip} GROUP BY 1, 2),
            c AS (SELECT number, count(*) AS clips, count(*) FILTER (red) AS redeemed, CAST(date_diff('day', max(d), DATE '{day}') AS INTEGER) AS dc"""
    + "".join(f", count(*) FILTER (dt = '{d}') AS clips_{d}" for d in DISCOUNTS)
    + "".join(f", count(*) FILTER (cat = '{k}') AS clips_{_name(k)}, count(*) FILTER (red AND cat = '{k}') AS redeemed_{_name(k)}" for k in CATEGORIES)
    + """ FROM k WHERE number IS NOT NULL GROUP BY 1)
            SELECT p.customer_id, coalesce(purchases, 0) AS purchases, coalesce(spent_cents, 0) AS spent_cents, dp AS days_since_purchase,
              coalesce(clips, 0) AS clips, coalesce(redeemed, 0) AS redeemed, dc AS days_since_clip"""
    + "".join(f", coalesce(clips_{d}, 0) AS clips_{d}" for d in DISCOUNTS)
    + "".join(f", coalesce(clips_{_name(k)}, 0) AS clips_{_name(k)}, coalesce(redeemed_{_name(k)}, 0) AS redeemed_{_name(k)}" for k in CATEGORIES)
    + " FROM p LEFT JOIN t USING (customer_id) LEFT JOIN c USING (number)"
)


def _features_sql(day: str, tx: str, clip: str) -> str:
    return _FEATURES.replace("{{1,10}}", "{1,10}").replace("{day}", day).replace("{tx}", tx).replace("{clip}", clip)


def _quantile_sql(key: str) -> str:
    columns = ", ".join(f"quantile_disc(total, {q}) AS p{round(q * 100):02d}" for q in (0.1, 0.5, 0.9, 0.99))
    return f"SELECT {key}, count(*) AS n, {columns} FROM transactions WHERE {key} IS NOT NULL AND total IS NOT NULL GROUP BY 1"


SQL = {
    "p2_found": """
        SELECT 'customer_id' AS field, CAST(customer_id AS BIGINT) AS key_id FROM transactions WHERE customer_id IS NOT NULL GROUP BY customer_id
          HAVING count(*) >= 0.02 * (SELECT count(*) FROM transactions)
        UNION ALL
        SELECT 'product_id', CAST(product_id AS BIGINT) FROM transactions WHERE product_id IS NOT NULL GROUP BY product_id
          HAVING count(*) >= 0.02 * (SELECT count(*) FROM transactions)""",
    "p2_totals": """
        WITH u AS (SELECT 'customer_id' AS field, customer_id AS key_id, transaction_id, total FROM transactions
          UNION ALL SELECT 'product_id', product_id, transaction_id, total FROM transactions),
        l AS (SELECT field, key_id, transaction_id, count(*) AS n, max(CAST(round(total * 100) AS BIGINT)) AS c FROM u WHERE key_id IS NOT NULL GROUP BY 1, 2, 3)
        SELECT field, key_id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS lines, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_cents FROM l GROUP BY 1, 2""",
    "p2_product_quantiles": _quantile_sql("product_id"),
    "p2_customer_quantiles": _quantile_sql("customer_id"),
    "p2_join": """
        SELECT transaction_id, t.customer_id, product_id, total, age, c.loyalty_number AS card FROM transactions t JOIN customers c ON c.customer_id = t.customer_id""",
    "p5_found": f"""
        WITH r AS (SELECT {_NUMBER.format("loyalty_number")} AS number FROM coupon_clips WHERE redeemed GROUP BY 1 HAVING count(DISTINCT clip_id) >= 2)
        SELECT CAST(customer_id AS BIGINT) AS customer_id FROM customers WHERE {_NUMBER.format("loyalty_number")} IN (SELECT number FROM r WHERE number IS NOT NULL)
          AND customer_id NOT IN (SELECT customer_id FROM transactions WHERE customer_id IS NOT NULL)""",
    "p5_features": _features_sql("2024-12-31", "true", "true"),
    "p5_recent": _features_sql("2024-12-20", "date BETWEEN DATE '2024-10-15' AND DATE '2024-12-20'", "clip_date BETWEEN DATE '2024-10-15' AND DATE '2024-12-20'"),
    "p6_found": _DAILY + " SELECT customer_id, strftime(day, '%Y-%m-%d') AS day FROM w WHERE c7 > 30000",
    "p6_rolling": _DAILY
    + """ SELECT customer_id, day, CAST(c7 AS BIGINT) AS cents_7, c7 / 7.0 AS average_cents_7, CAST(c30 AS BIGINT) AS cents_30, c30 / 30.0 AS average_cents_30 FROM w""",
}
