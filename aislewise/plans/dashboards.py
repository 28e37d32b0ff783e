"""Report queries over the feature tables (D), in SQL that both engines read; means of money come from exact sums."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.scalar import money_sum, ratio
from aislewise.operators import features
from aislewise.plans.analytics import CF, PF, PT, RESPONSE, RT, by_product, cf, pf, response, rounded, rt
from aislewise.plans.common import Book, Tables
from aislewise.staging import stage

BOOK = Book()
add, both = BOOK.add, BOOK.both


def money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(c: str) -> str:
    return f"({money(c)} / count({c}))"


FRAMES = {"pf": (pf, PF), "pt": (lambda t: features.coupon_tiers(pf(t)), PT), "cf": (cf, CF), "rt": (rt, RT)}


def report(name: str, text: str) -> None:
    """A statement over tables and the frames above."""
    used = [f for f in FRAMES if f"{{{f}}}" in text]
    ctes = [FRAMES[f][1] for f in used if not (f == "pf" and "pt" in used)]
    plain = re.sub(r"\{(\w+)\}", r"\1", text)
    prefix = ("WITH " + ", ".join(ctes) + (", " if plain.startswith("WITH ") else " ")) if ctes else ""
    body = plain[5:] if prefix and plain.startswith("WITH ") else plain
    add(name, lambda t: t.sql(text, **{f: FRAMES[f][0](t) for f in used}), prefix + body)


report("D1", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {{{n}}}" for n in ("stores", "products", "customers", "coupon_clips", "transactions", "pf", "cf")))
report("D2", f"""SELECT (SELECT {money("revenue")} FROM {{pf}}) AS revenue, (SELECT round(avg(margin), 9) FROM {{pf}}) AS margin, (SELECT {money("spend")} FROM {{cf}}) AS spend,
    (SELECT {mean("spend")} FROM {{cf}}) AS mean_spend, (SELECT CAST(sum(transactions) AS DOUBLE) / count(*) FROM {{cf}}) AS mean_transactions,
    (SELECT count(*) FROM {{coupon_clips}}) AS clips, (SELECT count(*) FROM {{coupon_clips}} WHERE redeemed) AS redeemed, (SELECT count(DISTINCT loyalty_number) FROM {{coupon_clips}}) AS clippers""")
report("D3", "SELECT state, count(*) AS stores FROM {stores} GROUP BY state")
DEMAND = f"SELECT state, count(*) AS customers, {money('spend')} AS revenue, {mean('spend')} AS mean_spend, CAST(sum(transactions) AS DOUBLE) / count(*) AS mean_transactions, CAST(sum(clips) AS BIGINT) AS clips, round(avg(engagement), 9) AS engagement FROM {{cf}} GROUP BY state"
report("D4", DEMAND)
report("D5", f"WITH d AS ({DEMAND}), s AS (SELECT state, count(*) AS stores FROM {{stores}} GROUP BY state) SELECT d.state, customers, stores, revenue / stores AS revenue_per_store, CAST(customers AS DOUBLE) / stores AS customers_per_store FROM d LEFT JOIN s ON s.state = d.state")
report("D6", f"""WITH m AS (SELECT state, {money("spend")} AS state_revenue FROM {{cf}} GROUP BY state)
    SELECT store_id, s.state, state_revenue, CAST(row_number() OVER (PARTITION BY s.state ORDER BY store_id) AS INT) AS place FROM {{stores}} s JOIN m ON m.state = s.state ORDER BY state_revenue DESC, store_id LIMIT 100""")
TOP = "SELECT product_id, name, brand, category, price, margin, units, revenue, buyers, clips, redemption_rate, tier FROM {pt} WHERE is_rx = false ORDER BY revenue DESC, product_id LIMIT 100"
report("D7", TOP)
report("D8", f"SELECT category, {money('revenue')} AS revenue, count(*) AS products FROM {{pf}} WHERE is_rx = false GROUP BY category")
add("D9", lambda t: pf(t).where("is_rx = false").groupBy("category").agg(F.count(F.lit(1)).alias("products"), F.round(F.avg("margin"), 9).alias("mean_margin"), F.min("margin").alias("least"), F.max("margin").alias("most"),
    *(F.round(F.expr(f"percentile(margin, {p}D)"), 9).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75)), money_sum("revenue").alias("revenue"), F.round(F.sum(F.col("revenue") * F.col("margin")), 3).alias("gross")),
    f"WITH {PF} SELECT category, count(*) AS products, round(avg(margin), 9) AS mean_margin, min(margin) AS least, max(margin) AS most, " + ", ".join(f"round(quantile_cont(margin, {p}), 9) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75)) + f", {money('revenue')} AS revenue, round(sum(revenue * margin), 3) AS gross FROM pf WHERE is_rx = false GROUP BY 1")
report("D10", "SELECT CAST(floor(margin * 50) AS INT) AS bin, count(*) AS n FROM {pf} WHERE is_rx = false AND margin IS NOT NULL GROUP BY CAST(floor(margin * 50) AS INT)")
report("D11", f"SELECT count(*) AS clips, count(CASE WHEN redeemed THEN 1 END) AS redeemed, CAST(count(CASE WHEN redeemed THEN 1 END) AS DOUBLE) * 100 / count(*) AS percent, count(DISTINCT loyalty_number) AS clippers, count(DISTINCT product_id) AS products, {mean('discount_value')} AS mean_value FROM {{coupon_clips}}")
report("D12", f"SELECT discount_type, count(*) AS clips, count(CASE WHEN redeemed THEN 1 END) AS redeemed, CAST(count(CASE WHEN redeemed THEN 1 END) AS DOUBLE) * 100 / count(*) AS percent, {mean('discount_value')} AS mean_value, count(DISTINCT loyalty_number) AS clippers FROM {{coupon_clips}} GROUP BY discount_type")
report("D13", "SELECT CAST(date_trunc('month', clip_date) AS DATE) AS month, count(*) AS clips, count(CASE WHEN redeemed THEN 1 END) AS redeemed FROM {coupon_clips} GROUP BY CAST(date_trunc('month', clip_date) AS DATE)")
report("D14", """SELECT c.product_id, t.name, t.brand, t.category, t.price, t.margin, count(*) AS n, count(CASE WHEN c.redeemed THEN 1 END) AS redeemed_clips, t.tier FROM {coupon_clips} c JOIN {pt} t ON t.product_id = c.product_id
    GROUP BY c.product_id, t.name, t.brand, t.category, t.price, t.margin, t.tier ORDER BY n DESC, c.product_id LIMIT 25""")
report("D15", f"SELECT tier, count(*) AS products, round(avg(margin), 9) AS mean_margin, {mean('revenue')} AS mean_revenue, {money('revenue')} AS revenue, CAST(sum(clips) AS DOUBLE) / count(*) AS mean_clips, round(avg(redemption_rate), 9) AS redemption, round(avg(organic_ratio), 9) AS organic FROM {{pt}} WHERE is_rx = false GROUP BY tier")
report("D16", "SELECT product_id, clip_rate, organic_ratio, margin, tier, revenue, units FROM {pt} WHERE is_rx = false AND units > 0")
SPEND = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
add("D17", lambda t: features.large_quantiles(cf(t), "spend", SPEND), f"WITH {CF} SELECT " + ", ".join(f"quantile_cont(spend, {p}) AS {k}" for k, p in SPEND.items()) + " FROM cf")


def segments(t: Tables) -> DataFrame:
    """Customers with a spend tier by quantiles of all spend and a coupon tier by use."""
    people = stage(cf(t).select("customer_id", "spend", "transactions", "clips", "redemption_rate"), "people")  # read by the quantiles and for the result
    cut = features.large_quantiles(people, "spend", {"p50": 0.5, "p80": 0.8, "p95": 0.95})
    tier = F.when(F.col("spend") >= F.col("p95"), "Platinum").when(F.col("spend") >= F.col("p80"), "Gold").when(F.col("spend") >= F.col("p50"), "Silver").otherwise("Bronze")
    use = F.when((F.col("clips") > 0) & (F.col("redemption_rate") >= 0.4), "Redeemer").when(F.col("clips") > 0, "Clipper").otherwise("Non-clipper")
    return people.crossJoin(F.broadcast(cut)).select("customer_id", "spend", "transactions", "clips", "redemption_rate", tier.alias("spend_tier"), use.alias("coupon_tier"))  # one row


SEG = CF + """, cu AS (SELECT quantile_cont(spend, 0.5) AS p50, quantile_cont(spend, 0.8) AS p80, quantile_cont(spend, 0.95) AS p95 FROM cf),
    sg AS (SELECT customer_id, spend, transactions, clips, redemption_rate, CASE WHEN spend >= p95 THEN 'Platinum' WHEN spend >= p80 THEN 'Gold' WHEN spend >= p50 THEN 'Silver' ELSE 'Bronze' END AS spend_tier,
      CASE WHEN clips > 0 AND redemption_rate >= 0.4 THEN 'Redeemer' WHEN clips > 0 THEN 'Clipper' ELSE 'Non-clipper' END AS coupon_tier FROM cf, cu)"""
add("D18", lambda t: segments(t).groupBy("spend_tier", "coupon_tier").agg(F.count(F.lit(1)).alias("customers"), ratio(F.sum(F.col("spend").cast("decimal(18,2)")), F.count(F.lit(1))).alias("mean_spend"), ratio(F.sum("transactions"), F.count(F.lit(1))).alias("mean_transactions"), F.round(F.avg("redemption_rate"), 9).alias("redemption")),
    f"WITH {SEG} SELECT spend_tier, coupon_tier, count(*) AS customers, {money('spend')} / count(*) AS mean_spend, CAST(sum(transactions) AS DOUBLE) / count(*) AS mean_transactions, round(avg(redemption_rate), 9) AS redemption FROM sg GROUP BY 1, 2")
report("A25", f"SELECT CASE WHEN age < 30 THEN 'young' WHEN age < 55 THEN 'middle' WHEN age IS NULL THEN 'unknown' ELSE 'older' END AS band, sensitivity, count(*) AS customers, {mean('spend')} AS mean_spend FROM {{cf}} GROUP BY CASE WHEN age < 30 THEN 'young' WHEN age < 55 THEN 'middle' WHEN age IS NULL THEN 'unknown' ELSE 'older' END, sensitivity")
add("D19", lambda t: segments(t).groupBy("spend_tier").pivot("coupon_tier", ["Redeemer", "Clipper", "Non-clipper"]).count().na.fill(0).select("spend_tier", F.col("Redeemer").alias("redeemers"), F.col("Clipper").alias("clippers"), F.col("Non-clipper").alias("others")),
    f"WITH {SEG} SELECT spend_tier, count(*) FILTER (coupon_tier = 'Redeemer') AS redeemers, count(*) FILTER (coupon_tier = 'Clipper') AS clippers, count(*) FILTER (coupon_tier = 'Non-clipper') AS others FROM sg GROUP BY 1")
add("A26", lambda t: cf(t).groupBy("sensitivity").pivot("gender", ["F", "M", "NB"]).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col("spend").cast("decimal(18,2)")), F.count(F.lit(1))).alias("mean")).na.fill(0)
    .select("sensitivity", *(F.col(f"{g}_{x}").alias(f"{x}_{g.lower()}") for g in ("F", "M", "NB") for x in ("n", "mean"))),
    f"WITH {CF} SELECT sensitivity, " + ", ".join(f"count(*) FILTER (gender = '{g}') AS n_{g.lower()}, coalesce(CAST(sum(CAST(spend AS DECIMAL(18,2))) FILTER (gender = '{g}') AS DOUBLE) / nullif(count(*) FILTER (gender = '{g}'), 0), 0) AS mean_{g.lower()}" for g in ("F", "M", "NB")) + " FROM cf GROUP BY 1")
report("D20", "SELECT customer_id, loyalty_number, age, gender, state, is_student, spend, transactions, avg_basket, clips, redeemed, redemption_rate, engagement FROM {cf} ORDER BY spend DESC, customer_id LIMIT 100")


def spend_share(t: Tables) -> DataFrame:
    by_tier = segments(t).groupBy("spend_tier").agg(F.count(F.lit(1)).alias("customers"), money_sum("spend").alias("revenue"), F.sum("clips").alias("clips"))
    return by_tier.withColumn("percent", F.round(F.col("revenue") * 100 / F.sum("revenue").over(Window.partitionBy()), 4))  # four rows


add("D21", spend_share, f"WITH {SEG} SELECT spend_tier, count(*) AS customers, {money('spend')} AS revenue, CAST(sum(clips) AS BIGINT) AS clips, round({money('spend')} * 100 / (SELECT sum(spend) FROM sg), 4) AS percent FROM sg GROUP BY 1")
report("D22", "SELECT product_id, category, price, margin, units, tier, round(units * margin * (1 + clip_rate * CAST(0.5 AS DOUBLE)), 6) AS priority FROM {pt} WHERE is_rx = false AND margin IS NOT NULL ORDER BY round(units * margin * (1 + clip_rate * CAST(0.5 AS DOUBLE)), 6) DESC, product_id LIMIT 50")
report("D23", "SELECT tier, count(*) AS products, CAST(sum(units) AS BIGINT) AS units, CAST(sum(units) AS DOUBLE) / count(*) AS velocity, round(avg(margin), 9) AS mean_margin, CAST(sum(clips) AS DOUBLE) / count(*) AS mean_clips FROM {pt} WHERE is_rx = false GROUP BY tier")
report("D24", "SELECT product_id, name, brand, margin, units, revenue, buyers, clips, margin * price AS dollar_margin FROM {pt} WHERE tier = 'hidden_gem' ORDER BY margin * price DESC, product_id LIMIT 30")
report("D25", f"""SELECT (SELECT {money("revenue")} FROM {{pf}} WHERE is_rx = false) AS revenue, (SELECT round(sum(revenue * margin), 2) FROM {{pf}} WHERE is_rx = false) AS gross, (SELECT count(CASE WHEN clips > 0 THEN 1 END) FROM {{cf}}) AS active,
    (SELECT round(avg(CASE WHEN clips > 0 THEN redemption_rate END), 9) FROM {{cf}}) AS redemption""")
report("D26", f"SELECT CASE WHEN margin < 0.35 THEN 'low' WHEN margin < 0.5 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM ({TOP}) x GROUP BY CASE WHEN margin < 0.35 THEN 'low' WHEN margin < 0.5 THEN 'middle' ELSE 'high' END")
report("D28", f"SELECT tier, count(*) AS products, {money('revenue')} AS revenue, round({money('revenue')} * 100 / (SELECT {money('revenue')} FROM {{rt}}), 6) AS percent FROM {{rt}} GROUP BY tier")
report("D29", "SELECT tier, product_id, revenue, place FROM (SELECT tier, product_id, revenue, CAST(row_number() OVER (PARTITION BY tier ORDER BY revenue DESC, product_id) AS INT) AS place FROM {rt}) x WHERE place <= 10")
WEEK = "CAST(floor(datediff(date, DATE '2024-01-01') / 7) AS INT)"
report("D30", f"WITH w AS (SELECT store_id, {WEEK} AS week, count(DISTINCT product_id) AS n FROM {{transactions}} WHERE date IS NOT NULL GROUP BY store_id, {WEEK}) SELECT store_id, week, CAST(sum(n) OVER (PARTITION BY store_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM w")
BOOK.sql["D30"] = BOOK.sql["D30"].replace("datediff(date, DATE '2024-01-01') / 7", "date_diff('day', DATE '2024-01-01', date) / 7.0")


def opportunities(t: Tables) -> DataFrame:
    """Products with a strong falling response and less revenue than the median."""
    known = stage(response(t).select("product_id", "beta", "at_zero"), "response")  # two regressions, read twice
    middle = known.agg(F.expr("percentile(at_zero, 0.5D)").alias("m"))
    return rounded(known.crossJoin(F.broadcast(middle)).where("beta < -1 AND at_zero < m").select("product_id", "beta"), "beta")  # one row


add("D31", opportunities,
    RESPONSE + " SELECT product_id, round(beta, 6) AS beta FROM rs WHERE beta < -1 AND at_zero < (SELECT quantile_cont(at_zero, 0.5) FROM rs)")
add("D32", lambda t: by_product(t).select("product_id", F.explode(F.array(*(F.struct(F.lit(d).alias("discount"), F.round(F.exp(F.col("beta") * d), 6).alias("demand")) for d in (0.0, 0.1, 0.2, 0.3)))).alias("x")).select("product_id", "x.*"),
    RESPONSE.split(", fp AS")[0] + " SELECT product_id, d AS discount, round(exp(beta * d), 6) AS demand FROM f, (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3)) v(d)")
report("D34", "SELECT product_id, count(DISTINCT store_id) AS stores, CAST(count(DISTINCT store_id) AS DOUBLE) / 240 AS consistency FROM {transactions} WHERE product_id IS NOT NULL GROUP BY product_id ORDER BY stores DESC, product_id LIMIT 100")
report("D36", "WITH s AS (SELECT tier, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {rt}) AS share FROM {rt} GROUP BY tier) SELECT tier, share, CASE WHEN share BETWEEN 0.1 AND 0.4 THEN 'inside' ELSE 'outside' END AS band FROM s")
report("D37", "SELECT t.product_id, t.tier, p.category, p.clips, p.redemption_rate FROM {rt} t JOIN {pf} p ON p.product_id = t.product_id WHERE t.tier = 2 ORDER BY p.clips DESC, t.product_id LIMIT 50")
report("D38", "SELECT t.product_id, t.tier, t.repeat_rate, p.margin FROM {rt} t JOIN {pf} p ON p.product_id = t.product_id WHERE p.margin > 0.5 ORDER BY t.repeat_rate DESC, p.margin DESC, t.product_id LIMIT 50")
report("D39", f"SELECT tier, {money('revenue')} AS revenue, {money('revenue')} * 0.05 AS budget FROM {{rt}} GROUP BY tier")
BOOK.sql["D39"] = BOOK.sql["D39"].replace("* 0.05", "* 0.05::DOUBLE")
BOOK.queries["D39"] = lambda spark, sf_dir: rt(Tables(spark, sf_dir)).groupBy("tier").agg(money_sum("revenue").alias("revenue")).withColumn("budget", F.col("revenue") * 0.05)

QUERIES, SQL = BOOK.queries, BOOK.sql
