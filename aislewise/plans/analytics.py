"""Views, features, tiers, response curves, vectors, ranking, quality (A, R, V, W, Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.scalar import dot, margin, money_sum, ratio
from aislewise.operators import breakout, elasticity, features, quality, ranking, series, vectors, warehouse
from aislewise.plans.common import Book, Tables

BOOK = Book()
add, both = BOOK.add, BOOK.both


def money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def draw_sql(*keys: int | str) -> str:
    """The same number as scalar.draw."""
    return "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


# ---- views

add("A1", lambda t: warehouse.customer_summary(t.transactions), f"""
    SELECT customer_id, count(*) AS transactions, count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores, {money("total")} AS spend,
      {money("total")} / nullif(count(total), 0) AS average, min(date) AS first_day, max(date) AS last_day FROM transactions GROUP BY 1""")
add("A2", lambda t: warehouse.monthly_sales(t.transactions), f"""
    SELECT product_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(quantity) AS BIGINT) AS units, {money("total")} AS revenue FROM transactions GROUP BY 1, 2""")
add("A3", lambda t: warehouse.store_performance(t.transactions), f"""
    SELECT store_id, count(DISTINCT customer_id) AS customers, count(*) AS transactions, {money("total")} AS revenue, {money("total")} / nullif(count(total), 0) AS average FROM transactions GROUP BY 1""")
add("A4", lambda t: warehouse.customer_product_matrix(t.transactions), f"""
    SELECT customer_id, product_id, count(*) AS purchases, {money("total")} AS spent, max(date) AS last_day FROM transactions GROUP BY 1, 2""")
add("A5", lambda t: warehouse.co_purchase(t.transactions), """
    SELECT a.product_id AS product_a, b.product_id AS product_b, count(*) AS co_purchases FROM transactions a
    JOIN transactions b ON a.customer_id = b.customer_id AND a.date = b.date AND a.product_id < b.product_id GROUP BY 1, 2""")

# ---- features and tiers

PF = f"""s AS (SELECT product_id, count(*) AS units, {money("total")} AS revenue, count(DISTINCT customer_id) AS buyers,
      CAST(sum(CAST(discount_pct AS DECIMAL(18,4))) AS DOUBLE) / count(discount_pct) AS avg_discount FROM transactions GROUP BY 1),
    c AS (SELECT product_id, count(*) AS clips, count(*) FILTER (redeemed) AS redeemed FROM coupon_clips GROUP BY 1),
    pf AS (SELECT p.product_id, name, brand, category, price, unit_cost, is_store_brand, is_rx, popularity_score, (price - unit_cost) / nullif(price, 0) AS margin,
      coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue, coalesce(buyers, 0) AS buyers, coalesce(avg_discount, 0) AS avg_discount,
      coalesce(clips, 0) AS clips, coalesce(redeemed, 0) AS redeemed, coalesce(CAST(redeemed AS DOUBLE) / clips, 0) AS redemption_rate,
      CASE WHEN coalesce(buyers, 0) > 0 THEN (buyers - coalesce(redeemed, 0)) / CAST(buyers AS DOUBLE) ELSE 1.0 END AS organic_ratio,
      CASE WHEN coalesce(buyers, 0) > 0 THEN coalesce(clips, 0) / CAST(buyers AS DOUBLE) ELSE 0.0 END AS clip_rate
      FROM products p LEFT JOIN s USING (product_id) LEFT JOIN c USING (product_id))"""
PT = PF + """, q AS (SELECT quantile_cont(clips, 0.3) AS c30, quantile_cont(clips, 0.7) AS c70, quantile_cont(units, 0.5) AS u50, quantile_cont(units, 0.7) AS u70 FROM pf),
    pt AS (SELECT pf.*, CASE WHEN clips >= c70 AND redemption_rate >= 0.4 THEN 'coupon_loyalist' WHEN clips >= c30 AND redemption_rate < 0.4 THEN 'coupon_curious'
      WHEN units >= u70 AND clips < c30 THEN 'organic_star' WHEN margin >= 0.45 AND units < u50 THEN 'hidden_gem' ELSE 'unclassified' END AS tier FROM pf, q)"""
CF = f"""b AS (SELECT customer_id, count(*) AS transactions, {money("total")} AS spend, count(total) AS priced,
      CAST(sum(CAST(discount_pct AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(discount_pct), 0) AS d FROM transactions GROUP BY 1),
    k AS (SELECT loyalty_number, count(*) AS clips, count(*) FILTER (redeemed) AS redeemed FROM coupon_clips GROUP BY 1),
    cf AS (SELECT CAST(customer_id AS BIGINT) AS customer_id, loyalty_number, age, gender, state, is_student, coalesce(spend, 0) AS spend, coalesce(spend / nullif(priced, 0), 0) AS avg_basket,
      coalesce(transactions, 0) AS transactions, coalesce(clips, 0) AS clips, coalesce(redeemed, 0) AS redeemed, coalesce(CAST(redeemed AS DOUBLE) / nullif(clips, 0), 0) AS redemption_rate,
      coalesce(coalesce(clips, 0) / CAST(nullif(transactions, 0) AS DOUBLE), 0) AS engagement,
      CASE WHEN coalesce(d, 0) < 0.05 THEN 0 WHEN d < 0.10 THEN 1 WHEN d < 0.15 THEN 2 WHEN d < 0.20 THEN 3 ELSE 4 END AS sensitivity
      FROM customers LEFT JOIN b USING (customer_id) LEFT JOIN k USING (loyalty_number))"""
RT = f"""pc AS (SELECT product_id, customer_id, count(*) AS n FROM transactions GROUP BY 1, 2),
    rep AS (SELECT product_id, count(*) FILTER (n >= 2) / CAST(count(*) AS DOUBLE) AS repeat_rate FROM pc GROUP BY 1),
    bs AS (SELECT customer_id, date, count(*) AS size FROM transactions WHERE customer_id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
    bk AS (SELECT product_id, CAST(sum(size) AS DOUBLE) / count(*) AS basket_size FROM transactions t JOIN bs ON bs.customer_id = t.customer_id AND bs.date = t.date GROUP BY 1),
    base AS (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, coalesce({money("subtotal")}, 0) AS revenue, count(DISTINCT customer_id) AS customers,
      count(*) FILTER (coalesce(discount_pct, 0) > 0) / CAST(count(*) AS DOUBLE) AS discounted, count(*) FILTER (coalesce(discount_pct, 0) <= 0) / CAST(count(*) AS DOUBLE) AS organic
      FROM transactions WHERE product_id IS NOT NULL GROUP BY 1),
    asm AS (SELECT base.*, coalesce(repeat_rate, 0) AS repeat_rate, coalesce(basket_size, 1) AS basket_size, CAST(rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank
      FROM base LEFT JOIN rep USING (product_id) LEFT JOIN bk USING (product_id)),
    rq AS (SELECT quantile_cont(units, 0.5) AS u50, quantile_cont(units, 0.25) AS u25 FROM asm),
    rt AS (SELECT asm.*, CASE WHEN revenue_rank <= 12 OR (revenue_rank <= 50 AND repeat_rate > 0.3) THEN 1 WHEN discounted > 0.5 AND units > u50 THEN 2
      WHEN organic > 0.7 AND units > u25 THEN 3 ELSE 4 END AS tier FROM asm, rq)"""


def pf(t: Tables) -> DataFrame:
    return features.product_features(t.transactions, t.coupon_clips, t.products)


def cf(t: Tables) -> DataFrame:
    return features.customer_features(t.transactions, t.coupon_clips, t.customers)


def rt(t: Tables) -> DataFrame:
    return features.revenue_tiers(t.transactions)


add("A8", pf, f"WITH {PF} SELECT * FROM pf")
add("A9", cf, f"WITH {CF} SELECT * FROM cf")
add("R1", lambda t: features.coupon_tiers(pf(t)), f"WITH {PT} SELECT * FROM pt")
add("R2", rt, f"WITH {RT} SELECT * FROM rt")
add("A11", lambda t: features.repeat_rates(t.transactions), f"WITH {RT} SELECT * FROM rep")
add("A12", lambda t: features.basket_sizes(t.transactions), f"WITH {RT} SELECT * FROM bk")
both("A6", """SELECT product_id, CAST(sum(CASE WHEN discount_pct > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS discounted,
    CAST(sum(CASE WHEN coalesce(discount_pct, 0) = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS organic FROM {transactions} GROUP BY product_id""")
both("A7", "SELECT discount_type, round(CAST(count(CASE WHEN redeemed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 4) AS rate FROM {coupon_clips} GROUP BY discount_type")
both("A10", f"""SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, {money("subtotal")} AS revenue, count(DISTINCT customer_id) AS customers,
    CAST(sum(CAST(discount_pct AS DECIMAL(18,4))) AS DOUBLE) / count(discount_pct) AS avg_discount FROM {{transactions}} GROUP BY product_id""")
both("A15", f"SELECT product_id, count(*) AS n, {money('total')} AS revenue FROM {{transactions}} GROUP BY product_id HAVING count(*) >= 50 AND sum(CAST(total AS DECIMAL(18,2))) > 500")
add("A16", lambda t: features.large_quantiles(cf(t), "spend", {"p25": 0.25, "p30": 0.3, "p50": 0.5, "p70": 0.7, "p80": 0.8, "p95": 0.95, "p99": 0.99}),
    f"WITH {CF} SELECT " + ", ".join(f"quantile_cont(spend, 0.{p}) AS p{p}" for p in (25, 30, 50, 70, 80, 95, 99)) + " FROM cf")
add("A17", lambda t: t.products.withColumn("margin", margin(F.col("price"), F.col("unit_cost"))).groupBy("category").agg(
    *(F.round(F.expr(f"percentile(margin, {p}D)"), 9).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75))),
    "SELECT category, " + ", ".join(f"round(quantile_cont((price - unit_cost) / nullif(price, 0), {p}), 9) AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75)) + " FROM products GROUP BY 1")
add("A18", lambda t: pf(t).agg(F.round(F.sum(F.col("revenue") * F.col("margin")), 2).alias("gross_profit")), f"WITH {PF} SELECT round(sum(revenue * margin), 2) AS gross_profit FROM pf")
add("A19", lambda t: pf(t).groupBy("category").agg(money_sum("revenue").alias("revenue")).withColumn("percent", F.round(F.col("revenue") * 100 / F.sum("revenue").over(Window.partitionBy()), 4)),
    f"WITH {PF} SELECT category, {money('revenue')} AS revenue, round({money('revenue')} * 100 / (SELECT sum(revenue) FROM pf), 4) AS percent FROM pf GROUP BY 1")
add("A20", lambda t: cf(t).agg(F.round(F.avg(F.when(F.col("clips") > 0, F.col("redemption_rate"))), 9).alias("rate")), f"WITH {CF} SELECT round(avg(CASE WHEN clips > 0 THEN redemption_rate END), 9) AS rate FROM cf")
both("A21", "SELECT round(avg(age), 9) AS mean_age, round(stddev_samp(age), 9) AS std_age, round(stddev_pop(age), 9) AS pop_age FROM {customers}")
both("A22", "SELECT count(DISTINCT loyalty_number) AS clippers, count(DISTINCT product_id) AS products FROM {coupon_clips}")
both("A23", "SELECT max(customer_id) AS largest, count(*) AS n FROM {customers}")
add("A24", lambda t: features.coupon_tiers(pf(t)).groupBy("tier").agg(F.count(F.lit(1)).alias("products"), F.sum("units").alias("units"), money_sum("revenue").alias("revenue"), ratio(F.sum("clips"), F.count(F.lit(1))).alias("avg_clips")),
    f"WITH {PT} SELECT tier, count(*) AS products, CAST(sum(units) AS BIGINT) AS units, {money('revenue')} AS revenue, CAST(sum(clips) AS DOUBLE) / count(*) AS avg_clips FROM pt GROUP BY 1")


def vectors_of(t: Tables, which: str) -> DataFrame:
    """The vectors stand for customers (even ids) and products (odd ids)."""
    return t.embeddings.where({"customers": "vec_id % 2 = 0", "products": "vec_id % 2 = 1"}[which])


DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
add("A27", lambda t: vectors.affinity(vectors_of(t, "customers"), vectors_of(t, "products"), "vec_id", "embedding", 0.3).select("id", F.round("total", 6).alias("total"), "above", F.round("average", 6).alias("average")),
    f"SELECT b.vec_id AS id, round(sum({DOT}), 6) AS total, count(*) FILTER ({DOT} > 0.3) AS above, round(avg({DOT}), 6) AS average FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1")


def group_affinity(t: Tables) -> DataFrame:
    """Mean score of each product in each group of customers: the groups' mean vectors against all products."""
    groups = vectors.mean_vectors(vectors_of(t, "customers"), "label", "embedding")
    products = vectors_of(t, "products").select(F.col("vec_id").alias("id"), F.col("embedding").alias("p"))
    top = products.crossJoin(F.broadcast(groups)).select("label", "n", "id", F.round(dot(F.col("p"), F.col("embedding")), 6).alias("score"))  # a handful of groups
    by = Window.partitionBy("label").orderBy(F.col("score").desc(), "id")
    return top.withColumn("place", F.row_number().over(by)).where("place <= 100").select("label", F.col("n").alias("customers"), "id", "score")


add("A28", group_affinity, f"""WITH s AS (SELECT a.label, b.vec_id AS id, round(avg({DOT}), 6) AS score, count(*) AS customers FROM embeddings a, embeddings b
      WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1, 2)
    SELECT label, customers, id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) <= 100""")


def state_offers(t: Tables) -> DataFrame:
    """The ten products with the highest mean score in each state of the customers that vectors with even ids stand for."""
    people = vectors_of(t, "customers").join(t.customers.select(F.col("customer_id").alias("vec_id"), F.upper(F.trim("state")).alias("state")), "vec_id").where("state IS NOT NULL")
    places = vectors.mean_vectors(people, "state", "embedding")
    products = vectors_of(t, "products").select(F.col("vec_id").alias("id"), F.col("embedding").alias("p"))
    top = products.crossJoin(F.broadcast(places)).select("state", F.col("n").alias("customers"), "id", F.round(dot(F.col("p"), F.col("embedding")), 6).alias("score"))  # one row per state
    by = Window.partitionBy("state").orderBy(F.col("score").desc(), "id")
    return top.withColumn("place", F.row_number().over(by)).where("place <= 10")


add("R18", state_offers, f"""WITH s AS (SELECT upper(trim(state)) AS state, b.vec_id AS id, round(avg({DOT}), 6) AS score, count(*) AS customers FROM embeddings a JOIN customers ON customer_id = a.vec_id, embeddings b
      WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND state IS NOT NULL GROUP BY 1, 2)
    SELECT state, customers, id, score, CAST(row_number() OVER (PARTITION BY state ORDER BY score DESC, id) AS INTEGER) AS place FROM s QUALIFY place <= 10""")
add("A30", lambda t: vectors.mean_vectors(t.embeddings.where("label = 1"), None, "embedding", True).select("n", F.posexplode("embedding").alias("pos", "x")).select("n", "pos", F.round("x", 6).alias("x")),
    """WITH u AS (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings WHERE label = 1), m AS (SELECT pos, avg(CAST(v AS DOUBLE)) AS m, count(*) AS n FROM u GROUP BY 1)
    SELECT n, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER ()), 6) AS x FROM m""")
both("A31", "SELECT category, count(*) AS n FROM {recommendations} WHERE rank = 1 GROUP BY category ORDER BY n DESC, category LIMIT 10")
both("A32", "SELECT round(avg(CAST(raw_score AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(raw_score AS DOUBLE)), 6) AS std, max(CAST(raw_score AS DOUBLE)) AS most FROM {recommendations} WHERE raw_score IS NOT NULL AND NOT isnan(raw_score)")

# ---- series: stores are runs, weeks are epochs

WEEKLY = f"wk AS (SELECT store_id, CAST((date - DATE '2024-01-01') AS INTEGER) // 7 AS week, {money('total')} AS revenue, count(*) AS n FROM transactions WHERE date IS NOT NULL GROUP BY 1, 2)"


def weekly(t: Tables) -> DataFrame:
    week = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("week")
    return t.transactions.where("date IS NOT NULL").groupBy("store_id", week).agg(money_sum("total").alias("revenue"), F.count(F.lit(1)).alias("n"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


add("A33", lambda t: rounded(series.bands(weekly(t), "week", "revenue"), "mean", "std", "low", "high", digits=4),
    f"WITH {WEEKLY}, s AS (SELECT week, count(revenue) AS runs, avg(revenue) AS mean, stddev_pop(revenue) AS std FROM wk GROUP BY 1) SELECT week, runs, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - 1.96 * std / sqrt(runs), 4) AS low, round(mean + 1.96 * std / sqrt(runs), 4) AS high FROM s")
add("A34", lambda t: t.transactions.agg(ratio(F.count_distinct("product_id"), F.lit(3000)).alias("coverage")), "SELECT count(DISTINCT product_id) / CAST(3000 AS DOUBLE) AS coverage FROM transactions")


def usual_volume(t: Tables) -> DataFrame:
    """The median number of lines of the products of tier 2 in the first week, at least 1; a product without any counts as 0."""
    first = t.transactions.where("date >= DATE '2024-01-01' AND date < DATE '2024-01-08'").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    volumes = rt(t).where("tier = 2").select("product_id").join(first, "product_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return volumes.agg(F.greatest(F.lit(1.0), F.floor(F.expr("percentile(n, 0.5D)")).cast("double")).alias("threshold"))


add("A35", usual_volume, f"""WITH {RT}, fw AS (SELECT product_id, count(*) AS n FROM transactions WHERE date >= DATE '2024-01-01' AND date < DATE '2024-01-08' GROUP BY 1)
    SELECT greatest(1.0::DOUBLE, floor(quantile_cont(coalesce(n, 0), 0.5))) AS threshold FROM rt LEFT JOIN fw USING (product_id) WHERE tier = 2""")
both("A36", "SELECT product_id, count(DISTINCT store_id) AS stores FROM {transactions} WHERE product_id IS NOT NULL GROUP BY product_id")
add("A37", lambda t: weekly(t).select("store_id", "week", F.sum("n").over(Window.partitionBy("store_id").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running")),
    f"WITH {WEEKLY} SELECT store_id, week, CAST(sum(n) OVER (PARTITION BY store_id ORDER BY week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM wk")
add("A38", lambda t: series.filled_running_total(weekly(t).select("store_id", "week", "n"), "week", "n", 0, 60, "store_id"),
    f"WITH {WEEKLY}, s AS (SELECT k.store_id, CAST(r.week AS INTEGER) AS week, coalesce(n, 0) AS n FROM (SELECT DISTINCT store_id FROM wk WHERE store_id IS NOT NULL) k, range(0, 61) r(week) LEFT JOIN wk ON wk.week = r.week AND wk.store_id = k.store_id) SELECT store_id, week, n, CAST(sum(n) OVER (PARTITION BY store_id ORDER BY week) AS BIGINT) AS running FROM s")
add("A39", lambda t: t.products.where("price <> 0 AND unit_cost IS NOT NULL").select(F.least(F.lit(49), F.floor((margin(F.col("price"), F.col("unit_cost")) + 1) / 2 * 50)).cast("int").alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
    "WITH m AS (SELECT CAST(least(49, floor(((price - unit_cost) / nullif(price, 0) + 1) / 2 * 50)) AS INTEGER) AS bin FROM products WHERE price <> 0) SELECT bin, count(*) AS n FROM m WHERE bin >= 0 GROUP BY 1")


def promoted(t: Tables) -> DataFrame:
    """The week in which a store first completes four weeks in a row with three lines or more."""
    return series.first_streak(weekly(t).withColumn("hit", F.col("n") >= 3), "store_id", "week", "hit", 4)


STREAK = f"""WITH {WEEKLY}, i AS (SELECT *, sum(CASE WHEN n >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY store_id ORDER BY week) AS g FROM wk),
    r AS (SELECT store_id, week, row_number() OVER (PARTITION BY store_id, g ORDER BY week) AS k FROM i WHERE n >= 3), st AS (SELECT store_id, min(week) AS week FROM r WHERE k = 4 GROUP BY 1)"""
add("W5", promoted, STREAK + " SELECT * FROM st")
add("D33", lambda t: series.filled_running_total(promoted(t).groupBy("week").agg(F.count(F.lit(1)).alias("n")), "week", "n", 0, 60),
    STREAK + ", e AS (SELECT CAST(r.week AS INTEGER) AS week, count(st.week) AS n FROM range(0, 61) r(week) LEFT JOIN st ON st.week = r.week GROUP BY 1) SELECT week, n, CAST(sum(n) OVER (ORDER BY week) AS BIGINT) AS running FROM e")
add("D27", lambda t: rounded(series.first_and_last(weekly(t), "week", ["revenue", "n"], 0.5), "first_mean", "last_mean", "last_std", "variation", "change", digits=5),
    f"""WITH {WEEKLY}, l AS (SELECT week, 'revenue' AS metric, revenue AS x FROM wk UNION ALL SELECT week, 'n', CAST(n AS DOUBLE) FROM wk), s AS (SELECT metric, week, avg(x) AS mean, stddev_pop(x) AS std FROM l GROUP BY 1, 2),
    e AS (SELECT metric, arg_min(mean, week) AS a, arg_max(mean, week) AS b, arg_max(std, week) AS d, min(week) FILTER (std / nullif(mean, 0) < 0.5) AS steady_at FROM s GROUP BY 1)
    SELECT metric, round(a, 5) AS first_mean, round(b, 5) AS last_mean, round(d, 5) AS last_std, steady_at, round(d / nullif(b, 0), 5) AS variation, round(b / nullif(a, 0) - 1, 5) AS change FROM e""")
#: Invented yearly figures that the weekly revenue is compared with.
FILED = {"last year": 4_000_000.0, "year before": 25_000.0, "segment": 2_900_000.0}
add("D35", lambda t: t.spark.createDataFrame(list(FILED.items()), "benchmark string, filed double").crossJoin(F.broadcast(weekly(t).agg(F.round(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double") * 52 / F.count_distinct("week"), 4).alias("yearly"))))  # one row
    .select("benchmark", "filed", "yearly", F.round((F.col("yearly") - F.col("filed")) / F.col("filed"), 6).alias("difference"), quality.compared(F.col("yearly"), F.col("filed")).alias("verdict")),
    f"WITH {WEEKLY}, y AS (SELECT round({money('revenue')} * 52 / count(DISTINCT week), 4) AS yearly FROM wk), k(benchmark, filed) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in FILED.items())
    + ") SELECT benchmark, filed, yearly, round((yearly - filed) / filed, 6) AS difference, CASE WHEN abs((yearly - filed) / filed) <= 0.2 THEN 'PASS' WHEN abs((yearly - filed) / filed) <= 0.35 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM k, y")
CV = "c AS (SELECT week, stddev_pop(revenue) / nullif(avg(revenue), 0) AS cv FROM wk GROUP BY 1)"
add("W6", lambda t: series.converged_at(weekly(t).groupBy("week").agg((F.stddev_pop("revenue") / F.nullif(F.avg("revenue"), F.lit(0.0))).alias("cv")), "week", "cv", 10, 2.5),
    f"WITH {WEEKLY}, {CV}, m AS (SELECT week, max(cv) OVER w AS most, count(*) OVER w AS k FROM c WINDOW w AS (ORDER BY week ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT min(week) AS converged_at FROM m WHERE k = 10 AND most < 2.5")
both("W7", f"SELECT category, month, revenue, CAST(sum(CAST(revenue AS DECIMAL(18,2))) OVER (PARTITION BY category ORDER BY month) AS DOUBLE) AS running FROM (SELECT p.category, CAST(date_trunc('month', t.date) AS DATE) AS month, {money('t.total')} AS revenue FROM {{transactions}} t JOIN {{products}} p ON p.product_id = t.product_id WHERE t.date IS NOT NULL GROUP BY p.category, CAST(date_trunc('month', t.date) AS DATE)) x")
add("W1", lambda t: pf(t).select("product_id", "revenue", F.rank().over(Window.orderBy(F.col("revenue").desc())).alias("place")), f"WITH {PF} SELECT product_id, revenue, CAST(rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS place FROM pf")
both("W3", "SELECT store_id, state, CAST(row_number() OVER (PARTITION BY state ORDER BY store_id) AS INT) AS place FROM {stores}")

# ---- discount response

LEVELS = """lv AS (SELECT c.product_id, category, CAST(round(CAST(CASE discount_type WHEN 'dollar_off' THEN least(discount_value / nullif(price, 0), 0.6) WHEN 'bogo' THEN 0.5 ELSE discount_value END AS DECIMAL(18,6)), 2) AS DOUBLE) AS level,
      count(*) AS clips, count(*) FILTER (redeemed) AS redeemed FROM coupon_clips c JOIN products p ON p.product_id = c.product_id GROUP BY 1, 2, 3)"""


def levels(t: Tables) -> DataFrame:
    return elasticity.response_levels(t.coupon_clips, t.products)


def by_product(t: Tables) -> DataFrame:
    return elasticity.weighted_slopes(elasticity.response_points(levels(t), ["product_id"], 3, 50), "product_id", "level", "log_rate", "clips")


def by_category(t: Tables) -> DataFrame:
    points = elasticity.response_points(levels(t), ["category"], 10)
    return elasticity.weighted_slopes(points.where("category IS NOT NULL"), "category", "level", "log_rate", "clips")


def fit_sql(points: str, key: str) -> str:
    return f"""m AS (SELECT {key}, count(*) AS points, count(DISTINCT level) AS xs, sum(clips * level) / sum(clips) AS mx, sum(clips * y) / sum(clips) AS my FROM {points} GROUP BY 1),
    s AS (SELECT {key}, points, sum(clips * (level - mx) * (level - mx)) AS sxx, sum(clips * (level - mx) * (y - my)) AS sxy, sum(clips * (y - my) * (y - my)) AS syy FROM {points} JOIN m USING ({key}) WHERE xs >= 2 GROUP BY 1, 2),
    f AS (SELECT {key}, points, sxy / sxx AS beta, CASE WHEN points > 2 THEN sqrt(CASE WHEN syy - sxy / sxx * sxy > 1e-15 THEN syy - sxy / sxx * sxy ELSE 0 END / greatest(points - 2, 1) / sxx) END AS se FROM s)"""


P_PRODUCT = LEVELS + """, pp AS (SELECT product_id, level, sum(clips) AS clips, ln(greatest(sum(redeemed) / CAST(sum(clips) AS DOUBLE), 1e-6)) AS y FROM lv WHERE level IS NOT NULL AND product_id IN (SELECT product_id FROM lv GROUP BY 1 HAVING sum(clips) >= 50)
      GROUP BY 1, 2 HAVING sum(clips) >= 3 AND sum(redeemed) > 0), """
P_CATEGORY = LEVELS + """, pp AS (SELECT category, level, sum(clips) AS clips, ln(greatest(sum(redeemed) / CAST(sum(clips) AS DOUBLE), 1e-6)) AS y FROM lv WHERE level IS NOT NULL AND category IS NOT NULL
      GROUP BY 1, 2 HAVING sum(clips) >= 10 AND sum(redeemed) > 0), """
add("A13", levels, f"WITH {LEVELS} SELECT * FROM lv")
both("A14", f"SELECT CAST(floor(price / 5) AS INT) AS band, lower(trim(category)) AS kind, count(*) AS n, {money('price')} AS total FROM {{products}} GROUP BY CAST(floor(price / 5) AS INT), lower(trim(category))")
add("R7", lambda t: rounded(by_product(t), "beta", "se").drop("p_value"), f"WITH {P_PRODUCT} {fit_sql('pp', 'product_id')} SELECT product_id, points, round(beta, 6) AS beta, round(se, 6) AS se FROM f")
# the two-sided tail of Student's t at whole degrees of freedom, in closed form over the angle atan(t / sqrt(dof))
TAIL = """, g AS (SELECT *, greatest(points - 2, 1) AS dof, CASE WHEN se > 0 THEN atan(abs(beta / se) / sqrt(greatest(points - 2, 1))) END AS a FROM f), h AS (SELECT *, cos(a) AS c1, CASE WHEN se > 0 THEN 1 - CASE WHEN dof % 2 = 1
      THEN 2 / pi() * (a + sin(a) * list_sum(list_transform(range(0, (dof - 1) // 2), lambda k: cos(a) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1) * cos(a) * cos(a))), 1))))
      ELSE sin(a) * list_sum(list_transform(range(0, dof // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j) * cos(a) * cos(a))), 1))) END END AS p FROM g)"""
TAIL = TAIL.replace("2 / pi() * (a + sin(a) * list_sum(", "2 / pi() * (a + sin(a) * coalesce(list_sum(").replace("* cos(a))), 1))))\n      ELSE", "* cos(a))), 1))), 0))\n      ELSE")
add("R7_p_values", lambda t: rounded(by_product(t), "beta", "se", "p_value"), f"WITH {P_PRODUCT} {fit_sql('pp', 'product_id')}{TAIL} SELECT product_id, points, round(beta, 6) AS beta, round(se, 6) AS se, round(p, 6) AS p_value FROM h")
add("F13", lambda t: rounded(by_category(t), "beta", "se", "p_value"), f"WITH {P_CATEGORY} {fit_sql('pp', 'category')}{TAIL} SELECT category, points, round(beta, 6) AS beta, round(se, 6) AS se, round(p, 6) AS p_value FROM h")
add("R8", lambda t: rounded(by_category(t), "beta", "se").drop("p_value"), f"WITH {P_CATEGORY} {fit_sql('pp', 'category')} SELECT category, points, round(beta, 6) AS beta, round(se, 6) AS se FROM f")
FALLBACK = f"""WITH {P_PRODUCT} {fit_sql('pp', 'product_id')}, fp AS (SELECT product_id, beta AS b1 FROM f),
    cc AS (SELECT category, level, sum(clips) AS clips, ln(greatest(sum(redeemed) / CAST(sum(clips) AS DOUBLE), 1e-6)) AS y FROM lv WHERE level IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2 HAVING sum(clips) >= 10 AND sum(redeemed) > 0),
    m2 AS (SELECT category, count(DISTINCT level) AS xs, sum(clips * level) / sum(clips) AS mx, sum(clips * y) / sum(clips) AS my FROM cc GROUP BY 1),
    fc AS (SELECT category, sum(clips * (level - mx) * (y - my)) / sum(clips * (level - mx) * (level - mx)) AS b2 FROM cc JOIN m2 USING (category) WHERE xs >= 2 GROUP BY 1),
    fb AS (SELECT product_id, category, coalesce(b1, b2, 0) AS beta, CASE WHEN b1 IS NOT NULL THEN 'product' WHEN b2 IS NOT NULL THEN 'category' ELSE 'none' END AS source FROM products LEFT JOIN fp USING (product_id) LEFT JOIN fc USING (category))"""


def fallback(t: Tables) -> DataFrame:
    return elasticity.with_fallback(t.products, by_product(t), by_category(t))


add("J13", lambda t: rounded(fallback(t), "beta"), FALLBACK + " SELECT product_id, category, round(beta, 6) AS beta, source FROM fb")


def response(t: Tables) -> DataFrame:
    joined = fallback(t).drop("category").join(pf(t), "product_id").where("price > 0")
    best = elasticity.best_discount(F.col("beta"), F.col("organic_ratio"))
    shaped = joined.withColumn("best", best).select(
        "product_id", "category", "beta", "best", elasticity.revenue_at(F.col("price"), F.col("units"), F.col("beta"), F.col("best")).alias("at_best"),
        elasticity.revenue_at(F.col("price"), F.col("units"), F.col("beta"), F.lit(0.0)).alias("at_zero"), elasticity.sensitivity(F.col("beta"), F.col("organic_ratio")).alias("sensitivity"),
    )
    return shaped


RESPONSE = FALLBACK + ", " + PF + """, d AS (SELECT fb.product_id, pf.category, beta, price, units, organic_ratio, (CASE WHEN beta > 1 THEN greatest(0, least(1 - 1 / beta, 0.5)) ELSE 0 END) * (CASE WHEN organic_ratio > 0.5 THEN 2 * (1 - organic_ratio) ELSE 1 END) AS best FROM fb JOIN pf USING (product_id) WHERE price > 0),
    rs AS (SELECT product_id, category, beta, best, price * greatest(units, 1) * (1 - best) * exp(beta * best) AS at_best, price * greatest(units, 1) AS at_zero,
      CASE WHEN organic_ratio > 0.5 THEN -(organic_ratio - 0.3) * (1 + abs(beta)) WHEN beta > 0 THEN beta * (1 - organic_ratio) ELSE 0.1 * beta END AS sensitivity FROM d)"""
RESPONSE = RESPONSE.replace("c AS (SELECT product_id, count(*) AS clips, count(*) FILTER", "c0 AS (SELECT product_id, count(*) AS clips, count(*) FILTER").replace("LEFT JOIN c USING", "LEFT JOIN c0 USING").replace("s AS (SELECT product_id, count(*) AS units", "s0 AS (SELECT product_id, count(*) AS units").replace("LEFT JOIN s USING", "LEFT JOIN s0 USING")
add("R10", lambda t: rounded(response(t).select("product_id", "best"), "best"), RESPONSE + " SELECT product_id, round(best, 6) AS best FROM rs")
add("R11", lambda t: rounded(response(t).select("product_id", "at_best", "at_zero"), "at_best", "at_zero", digits=3), RESPONSE + " SELECT product_id, round(at_best, 3) AS at_best, round(at_zero, 3) AS at_zero FROM rs")
add("R12", lambda t: rounded(response(t).select("product_id", "sensitivity"), "sensitivity"), RESPONSE + " SELECT product_id, round(sensitivity, 6) AS sensitivity FROM rs")
add("R13", lambda t: rounded(response(t), "beta").orderBy(F.col("beta").desc(), "product_id").limit(10).select("product_id", "beta"), RESPONSE + " SELECT product_id, round(beta, 6) AS beta FROM rs ORDER BY round(beta, 6) DESC, product_id LIMIT 10")
add("A29", lambda t: response(t).groupBy("category").agg(F.round(F.avg(F.abs("beta")), 6).alias("mean_abs_beta")), RESPONSE + " SELECT category, round(avg(abs(beta)), 6) AS mean_abs_beta FROM rs GROUP BY 1")
add("R9", lambda t: elasticity.organic_strength(t.transactions, pf(t)), f"WITH {PF} SELECT product_id, organic_ratio, 1 - organic_ratio AS discount_ratio, revenue, units, redemption_rate, clips FROM pf")
STRENGTH = f"""SELECT product_id, count(*) FILTER (coalesce(discount_pct, 0) = 0) / CAST(count(*) AS DOUBLE) AS organic_ratio, count(*) FILTER (coalesce(discount_pct, 0) > 0) / CAST(count(*) AS DOUBLE) AS discount_ratio,
      {money("subtotal")} AS revenue, CAST(sum(quantity) AS BIGINT) AS units, 0.0::DOUBLE AS redemption_rate, CAST(0 AS BIGINT) AS clips FROM transactions"""
add("R9_purchases", lambda t: elasticity.organic_strength(t.transactions), STRENGTH + " GROUP BY 1")
add("R9_sample", lambda t: elasticity.organic_strength(t.transactions, share=0.05), f"{STRENGTH} WHERE {draw_sql(42, 'transaction_id')} < 0.05 GROUP BY 1")
add("R3", lambda t: rt(t).join(t.products.select("product_id", "name", "price"), "product_id").withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("revenue").desc(), "product_id"))).groupBy("tier").agg(
    F.count(F.lit(1)).alias("products"), money_sum("revenue").alias("revenue"), F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 10, F.struct("place", "product_id")))), lambda x: x["product_id"]).alias("top")),
    f"WITH {RT}, j AS (SELECT tier, product_id, revenue, row_number() OVER (PARTITION BY tier ORDER BY revenue DESC, product_id) AS place FROM rt JOIN products USING (product_id)) SELECT tier, count(*) AS products, {money('revenue')} AS revenue, list(product_id ORDER BY place) FILTER (place <= 10) AS top FROM j GROUP BY 1")

# ---- vectors

UNIT = "u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"


def top_sql(where: str, k: int) -> str:
    return f"""WITH {UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score, round(list_dot_product(a.e, b.e) / (a.n * b.n), 12) AS exact FROM u a, u b WHERE {where})
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) <= {k}"""


add("V1", lambda t: vectors.normalised(t.embeddings, "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 9)),
    f"WITH {UNIT} SELECT vec_id, CAST(unnest(range(len(e))) AS INTEGER) AS pos, round(unnest(list_transform(e, lambda x: x / n)), 9) AS x FROM u")
add("V3", lambda t: rounded(vectors.top_k_cosine(t.embeddings.where("vec_id = 100"), t.embeddings, "vec_id", "embedding", 10), "score"), top_sql("a.vec_id = 100", 10))
add("V3_padded", lambda t: vectors.top_k_cosine(t.embeddings.where("vec_id = 100"), t.embeddings.where("vec_id < 3"), "vec_id", "embedding", 5, pad=True).select("query_id", "place", F.round("score", 6).alias("score")),
    f"""WITH {UNIT}, s AS (SELECT round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score, row_number() OVER (ORDER BY list_dot_product(a.e, b.e) / (a.n * b.n) DESC) AS place FROM u a, u b WHERE a.vec_id = 100 AND b.vec_id < 3)
    SELECT CAST(100 AS BIGINT) AS query_id, CAST(p.place AS INTEGER) AS place, coalesce(score, 0) AS score FROM range(1, 6) p(place) LEFT JOIN s ON s.place = p.place""")
add("V4", lambda t: rounded(vectors.top_k_cosine(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 10), "score"), top_sql("a.vec_id % 100 = 0", 10))
#: The three best products of each customer by plain scores, and the hundred best pairs of all.
add("L4", lambda t: vectors.all_pairs(vectors_of(t, "customers"), vectors_of(t, "products"), "vec_id", "embedding").withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id"))).where("place <= 3"),
    f"WITH s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS INTEGER) AS place FROM s QUALIFY place <= 3")
add("L5", lambda t: rounded(vectors.all_pairs(vectors_of(t, "customers"), vectors_of(t, "products"), "vec_id", "embedding"), "score").orderBy(F.col("score").desc(), "left_id", "right_id").limit(100),
    f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 ORDER BY 3 DESC, 1, 2 LIMIT 100")
#: The other direction of V4: for products (odd ids) the customers (even ids) with the highest score; every product is a query.
add("R19", lambda t: vectors.top_k_cosine(vectors_of(t, "products"), vectors_of(t, "customers"), "vec_id", "embedding", 5).withColumnsRenamed({"query_id": "product_id", "id": "customer_id"}).withColumn("score", F.round("score", 6)),
    top_sql("a.vec_id % 2 = 1 AND b.vec_id % 2 = 0", 5).replace("SELECT query_id, id, score,", "SELECT query_id AS product_id, id AS customer_id, score,"))
add("J11", lambda t: rounded(vectors.all_pairs(vectors_of(t, "customers"), vectors_of(t, "products"), "vec_id", "embedding"), "score"),
    f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1")
both("V5", "SELECT count(*) AS n, min(cardinality(embedding)) AS dims, max(cardinality(embedding)) AS most FROM {embeddings}")
BOOK.sql["V5"] = "SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dims, CAST(max(len(embedding)) AS INTEGER) AS most FROM embeddings"
add("R17", lambda t: rounded(vectors.demand_ranking(vectors.affinity(vectors_of(t, "customers"), vectors_of(t, "products"), "vec_id", "embedding", 0.3), pf(t)).where("price > 0"), "average", "demand", "score", digits=5).select("product_id", "average", "above", "demand", "score"),
    f"WITH {PF}, a AS (SELECT b.vec_id AS product_id, count(*) FILTER ({DOT} > 0.3) AS above, avg({DOT}) AS average FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1) SELECT CAST(product_id AS INTEGER) AS product_id, round(average, 5) AS average, above, round(average * buyers, 5) AS demand, round(average * buyers * (margin * price), 5) AS score FROM a JOIN pf USING (product_id) WHERE price > 0")
BOOK.sql["R17"] = BOOK.sql["R17"].replace("average * buyers * (margin * price)", "average * buyers * margin * price")

# ---- ranking

RECENT = "lp AS (SELECT customer_id, product_id, max(date) AS last_day FROM transactions WHERE customer_id IS NOT NULL AND product_id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2), rc AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, product_id) AS INTEGER) AS place FROM lp QUALIFY place <= 5)"
CLIPPED = "cp AS (SELECT DISTINCT CAST(customer_id AS BIGINT) AS customer_id, product_id FROM coupon_clips JOIN customers USING (loyalty_number))"
add("R5", lambda t: ranking.last_products(t.transactions, 5), f"WITH {RECENT} SELECT * FROM rc")
both("W2", f"SELECT store_id, product_id, revenue, place FROM (SELECT store_id, product_id, revenue, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, product_id) AS INT) AS place FROM (SELECT store_id, product_id, {money('total')} AS revenue FROM {{transactions}} WHERE product_id IS NOT NULL AND total IS NOT NULL GROUP BY store_id, product_id) x) y WHERE place <= 3")
add("R6", lambda t: ranking.clipped_products(t.coupon_clips, t.customers), f"WITH {CLIPPED} SELECT * FROM cp")
add("R4", lambda t: rounded(ranking.constrained_top(t.recommendations.select(F.col("customer_id").cast("bigint").alias("customer_id"), F.col("product_id").cast("bigint").alias("product_id"), F.col("raw_score").alias("score"), "category", F.col("margin_pct").alias("margin")),
                                                  ranking.last_products(t.transactions, 5), ranking.clipped_products(t.coupon_clips, t.customers)), "score", "final"),
    f"""WITH {RECENT}, {CLIPPED}, b AS (SELECT customer_id, product_id, raw_score AS s, category, margin_pct AS m FROM recommendations WHERE raw_score IS NOT NULL AND NOT isnan(raw_score)
      QUALIFY row_number() OVER (PARTITION BY customer_id, product_id ORDER BY raw_score DESC, margin_pct DESC NULLS LAST, category DESC NULLS LAST) = 1),
    f AS (SELECT b.customer_id, b.product_id, category, CAST(s AS DOUBLE) AS score, CAST(s AS DOUBLE) * (1 + coalesce(CAST(m AS DOUBLE), 0) * 0.3) * (CASE WHEN rc.product_id IS NOT NULL THEN 0.5 ELSE 1.0 END) * (CASE WHEN cp.product_id IS NOT NULL THEN 1.15 ELSE 1.0 END) AS final
      FROM b LEFT JOIN rc ON rc.customer_id = b.customer_id AND rc.product_id = b.product_id LEFT JOIN cp ON cp.customer_id = b.customer_id AND cp.product_id = b.product_id),
    p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY final DESC, product_id) <= 50),
    q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY customer_id, category ORDER BY final DESC, product_id) <= 3)
    SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(product_id AS BIGINT) AS product_id, category, round(score, 6) AS score, round(final, 6) AS final, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY final DESC, product_id) AS INTEGER) AS place FROM q
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY final DESC, product_id) <= 10""")
both("W4", "SELECT product_id, category, popularity_score FROM (SELECT product_id, category, popularity_score, row_number() OVER (PARTITION BY category ORDER BY popularity_score DESC, product_id) AS place FROM {products} WHERE popularity_score IS NOT NULL) x WHERE place <= 3 ORDER BY popularity_score DESC, product_id LIMIT 20")
add("J12", lambda t: rounded(ranking.adjusted(t.recommendations.where("raw_score IS NOT NULL").select("customer_id", "product_id", F.col("raw_score").cast("double").alias("score")), ranking.last_products(t.transactions, 5), ranking.clipped_products(t.coupon_clips, t.customers), 0.5, 1.15), "score"),
    f"""WITH {RECENT}, {CLIPPED} SELECT r.customer_id, r.product_id, round(CAST(raw_score AS DOUBLE) * (CASE WHEN rc.product_id IS NOT NULL THEN 0.5 ELSE 1.0 END) * (CASE WHEN cp.product_id IS NOT NULL THEN 1.15 ELSE 1.0 END), 6) AS score FROM recommendations r
      LEFT JOIN rc ON rc.customer_id = r.customer_id AND rc.product_id = r.product_id LEFT JOIN cp ON cp.customer_id = r.customer_id AND cp.product_id = r.product_id WHERE raw_score IS NOT NULL""")
both("L3", "SELECT product_id, category, brand, price, popularity_score FROM {products} WHERE price IS NOT NULL ORDER BY category NULLS FIRST, price DESC, popularity_score DESC NULLS LAST, product_id LIMIT 200")


def lookalikes(t: Tables) -> DataFrame:
    held = t.embeddings.select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))
    strength = response(t).groupBy("category").agg(F.avg(F.abs("beta")).alias("strength"))
    return breakout.lookalikes(held, rt(t), t.products, strength)


LOOK = f"""{RESPONSE}, {RT}, el AS (SELECT category, avg(abs(beta)) AS strength FROM rs WHERE category IS NOT NULL GROUP BY 1),
    th AS (SELECT coalesce((SELECT quantile_cont(units, 0.25) FROM rt WHERE tier = 2), (SELECT quantile_cont(units, 0.5) FROM rt)) AS goal), v AS (SELECT vec_id AS product_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, tier, units, revenue FROM embeddings JOIN rt ON rt.product_id = vec_id),
    x AS (SELECT unnest(range(len(e))) AS pos, unnest(e) AS y FROM v WHERE tier = 1), mm AS (SELECT pos, avg(y) AS y FROM x GROUP BY 1), ce AS (SELECT list(y / nrm ORDER BY pos) AS e FROM (SELECT pos, y, sqrt(sum(y * y) OVER ()) AS nrm FROM mm)),
    nn AS (SELECT a.product_id, b.product_id AS nearest, round(list_dot_product(a.e, b.e) / (a.n * b.n), 12) AS s FROM v a, v b WHERE a.tier = 4 AND b.tier = 1 QUALIFY row_number() OVER (PARTITION BY a.product_id ORDER BY s DESC, nearest) = 1),
    o AS (SELECT v.product_id, p.category, p.brand, round(list_dot_product(v.e, ce.e) / v.n, 4) AS cosine, nearest, q.name AS nearest_name, round(s, 4) AS similarity, round(1 - s, 4) AS distance, units, revenue, coalesce(el.strength, 0.75) AS strength, goal, round(p.price / greatest(coalesce(q.price, p.price), 0.01), 4) AS price_ratio,
      CAST(p.category IN (SELECT category FROM products JOIN v ON v.product_id = products.product_id WHERE tier = 1 AND category IS NOT NULL) AS INTEGER) AS sc, CAST(p.brand IN (SELECT brand FROM products JOIN v ON v.product_id = products.product_id WHERE tier = 1 AND brand IS NOT NULL) AS INTEGER) AS sb
      FROM v JOIN nn USING (product_id) JOIN products p ON p.product_id = v.product_id LEFT JOIN products q ON q.product_id = nearest LEFT JOIN el ON el.category = p.category, ce, th WHERE v.tier = 4),
    od AS (SELECT *, round(CASE WHEN units > 0 AND strength > 0.01 THEN CASE WHEN goal / units > 1 THEN greatest(0.05, least(0.5, ln(goal / units) / (strength * 7))) ELSE 0.05 END ELSE 0.5 END, 4) AS discount FROM o),
    lk AS (SELECT product_id, category, brand, cosine, nearest, nearest_name, similarity, distance, price_ratio, coalesce(sc, 0) AS same_category, coalesce(sb, 0) AS same_brand, discount, round(strength, 4) AS strength,
      CAST(round_even(units / 12.0::DOUBLE, 0) AS BIGINT) AS monthly_units, floor((2 * CAST(round(revenue * 100) AS BIGINT) + 12) / 24.0::DOUBLE) / 100 AS monthly_revenue,
      round(0.2 * cosine + 0.2 * coalesce(sc, 0) + 0.2 * coalesce(greatest(0, 1 - abs(price_ratio - 1)), 0) + 0.2 * coalesce(sb, 0) - 0.2 * discount, 4) AS score FROM od)"""
add("R14", lambda t: lookalikes(t).drop("score"), LOOK + " SELECT * EXCLUDE (score) FROM lk")
add("R15", lambda t: lookalikes(t).select("product_id", "score").orderBy(F.col("score").desc(), "product_id").limit(100), LOOK + " SELECT product_id, score FROM lk ORDER BY score DESC, product_id LIMIT 100")
add("P19", lambda t: lookalikes(t).groupBy("same_category", "same_brand").agg(F.count(F.lit(1)).alias("n")), LOOK + " SELECT same_category, same_brand, count(*) AS n FROM lk GROUP BY 1, 2")

# ---- quality

LEAST = {"stores": 100, "products": 1000, "customers": 100_000, "transactions": 1}


def checks(t: Tables) -> DataFrame:
    return quality.warehouse_checks({n: getattr(t, n) for n in ("transactions", "products", "customers", "stores")}, LEAST, "2024-01-01", "2025-12-31")


CHECKS = " UNION ALL ".join(
    [f"SELECT '{n} rows' AS \"check\", count(*) AS value, count(*) >= {k} AS passed FROM {n}" for n, k in LEAST.items()]
    + [
        f"SELECT '{name}' AS \"check\", count(*) AS value, count(*) = 0 AS passed FROM {source}"
        for name, source in {
            "null customer_id": "customers WHERE customer_id IS NULL", "null product_id": "products WHERE product_id IS NULL", "repeated store_id": "(SELECT store_id FROM stores GROUP BY 1 HAVING count(*) > 1)",
            "orphan customers": "(SELECT DISTINCT customer_id FROM transactions WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers))",
            "orphan products": "(SELECT DISTINCT product_id FROM transactions WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM products))",
            "days outside": "transactions WHERE date < DATE '2024-01-01' OR date > DATE '2025-12-31'", "negative totals": "transactions WHERE total < 0", "prices not positive": "products WHERE price <= 0", "ages outside": "customers WHERE age < 18 OR age > 100",
        }.items()
    ]
)
add("Q1", checks, CHECKS)
MORE_THAN = {"stores": 1000, "products": 5000, "customers": 100_000}
VALIDATION = " UNION ALL ".join(
    [f"SELECT '{n} count' AS \"check\", count(*) AS value, count(*) > {k} AS passed FROM {n}" for n, k in MORE_THAN.items()]
    + [
        f"SELECT '{name}' AS \"check\", count(*) AS value, {passed} AS passed FROM {source}"
        for name, passed, source in (
            ("null customer_id", "count(*) = 0", "customers WHERE customer_id IS NULL"), ("null product_id", "count(*) = 0", "products WHERE product_id IS NULL"), ("prices positive", "count(*) = 0", "products WHERE price <= 0"),
            ("ages in range", "count(*) = 0", "customers WHERE age < 18 OR age > 100"), ("no negative totals", "count(*) = 0", "transactions WHERE total < 0"),
            ("customers of purchases", "true", "(SELECT DISTINCT customer_id FROM transactions) t LEFT JOIN customers c ON c.customer_id = t.customer_id WHERE c.customer_id IS NULL"),
            ("products of purchases", "true", "(SELECT DISTINCT product_id FROM transactions) t LEFT JOIN products p ON p.product_id = t.product_id WHERE p.product_id IS NULL"),
        )
    ]
)
add("Q2", lambda t: quality.validation_checks({n: getattr(t, n) for n in ("transactions", "products", "customers", "stores")}, MORE_THAN), VALIDATION)
add("Q3", lambda t: cf(t).groupBy("state").agg(ratio(F.sum(F.col("spend").cast("decimal(18,2)")), F.count(F.lit(1))).alias("mean")).withColumn("verdict", quality.verdict(F.col("mean"), F.lit(100.0), F.lit(180.0))),
    f"""WITH {CF}, m AS (SELECT state, {money("spend")} / count(*) AS mean FROM cf GROUP BY 1), d AS (SELECT *, greatest(100.0 - mean, mean - 180.0, 0) / 40.0 AS away FROM m)
    SELECT state, mean, CASE WHEN mean IS NULL THEN NULL WHEN away <= 0.2::DOUBLE / 0.21::DOUBLE THEN 'PASS' WHEN away <= 0.5::DOUBLE / 0.21::DOUBLE THEN 'WARN' ELSE 'FAIL' END AS verdict FROM d""")

QUERIES, SQL = BOOK.queries, BOOK.sql
