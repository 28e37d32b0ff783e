"""Encoders, replications, pages (M, T, S22)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.scalar import dot, draw, lookup
from aislewise.operators import ranking, replications, series, towers, training, vectors
from aislewise.plans.analytics import CF, PF, cf, draw_sql, pf, rounded
from aislewise.plans.common import Book, Tables
from aislewise.plans.relational import labelled_pairs
from aislewise.sources.pages import ATTRIBUTE, store_pages
from aislewise.staging import new_path, stage

BOOK = Book()
add = BOOK.add
#: Sizes of the encoders' layers.
HIDDEN, OUT = 32, 16


def layers(inputs: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights by a rule, in eighths: stand-ins for trained ones, which the operators take as arguments."""

    def weights(rows: int, columns: int) -> np.ndarray:
        i, j = np.indices((rows, columns))
        return ((7 * i + 13 * j + 5 * seed + i * j) % 11 - 5) / 8

    return [(weights(inputs, HIDDEN), np.zeros(HIDDEN)), (weights(HIDDEN, OUT), np.zeros(OUT))]


def encoded_sql(source: str, seed: int) -> str:
    """CTE text: the vector e (of FLOAT) of each row of `source`, whose column x lists the inputs."""

    def weight(i: str, j: str) -> str:
        return f"((7 * {i} + 13 * {j} + {5 * seed} + {i} * {j}) % 11 - 5) / 8.0::DOUBLE"

    return f"""(SELECT * EXCLUDE (x, h, o), list_transform(o, lambda y: CAST(y / CASE WHEN n > 1e-12 THEN n ELSE 1 END AS FLOAT)) AS e FROM (SELECT *, sqrt(list_dot_product(o, o)) AS n FROM (SELECT *,
      list_transform(range(0, {OUT}), lambda k: list_sum(list_transform(range(0, {HIDDEN}), lambda j: h[j + 1] * {weight("j", "k")}))) AS o FROM (SELECT *,
      list_transform(range(0, {HIDDEN}), lambda j: greatest(0.0::DOUBLE, list_sum(list_transform(range(0, len(x)), lambda i: x[i + 1] * {weight("i", "j")})))) AS h FROM ({source})))))"""


def customer_vectors(t: Tables) -> DataFrame:
    inputs = cf(t).select("customer_id", (F.col("age") / 100).alias("a"), F.log1p("spend").alias("s"), "redemption_rate", "engagement", (F.col("sensitivity") / 4).alias("b"), lookup(F.col("gender"), {"F": 0, "M": 1, "NB": 2}, -1).alias("g"))
    return towers.encode_rows(inputs, "customer_id", ["a", "s", "redemption_rate", "engagement", "b", "g"], layers(6, 1))


def product_vectors(t: Tables, discount: float = 0.0) -> DataFrame:
    inputs = pf(t).select("product_id", F.log1p(F.coalesce("price", F.lit(0.0))).alias("p"), "margin", "popularity_score", "redemption_rate", "organic_ratio", F.lit(discount).alias("d"))
    return towers.encode_rows(inputs, "product_id", ["p", "margin", "popularity_score", "redemption_rate", "organic_ratio", "d"], layers(6, 2))


def discount_curves(t: Tables) -> DataFrame:
    """Mean score of each product over all customers at discounts from 0 to 30%: its vector at the level times the mean customer vector."""
    mean = vectors.mean_vectors(customer_vectors(t), None, "vector").select(F.col("vector").alias("m"))
    parts = [product_vectors(t, d / 100).withColumn("discount", F.lit(d / 100)) for d in range(0, 31, 5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.crossJoin(F.broadcast(mean)).select("product_id", "discount", F.round(dot(F.col("vector"), F.col("m")), 5).alias("score"))  # one row


CUSTOMER_INPUTS = f"""SELECT customer_id, [coalesce(age, 0) / 100.0::DOUBLE, CASE WHEN spend > -1 THEN ln(1 + spend) ELSE 0 END, coalesce(redemption_rate, 0), coalesce(engagement, 0), coalesce(sensitivity, 0) / 4.0::DOUBLE,
      CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'NB' THEN 2 ELSE -1 END::DOUBLE] AS x FROM cf"""
PRODUCT_INPUTS = "SELECT product_id, {d} AS discount, [CASE WHEN coalesce(price, 0) > -1 THEN ln(1 + coalesce(price, 0)) ELSE 0 END, coalesce(margin, 0), coalesce(popularity_score, 0), coalesce(redemption_rate, 0), coalesce(organic_ratio, 0), {d}] AS x FROM pf{more}"
add("M1", lambda t: customer_vectors(t).select("customer_id", F.posexplode("vector").alias("pos", "x")),
    f"WITH {CF}, ec AS {encoded_sql(CUSTOMER_INPUTS, 1)} SELECT customer_id, CAST(unnest(range(len(e))) AS INTEGER) AS pos, unnest(e) AS x FROM ec")
add("M6", lambda t: product_vectors(t).select("product_id", F.posexplode("vector").alias("pos", "x")),
    f"WITH {PF}, ep AS {encoded_sql(PRODUCT_INPUTS.format(d='0.0::DOUBLE', more=''), 2)} SELECT product_id, CAST(unnest(range(len(e))) AS INTEGER) AS pos, unnest(e) AS x FROM ep")
#: The same statement's CTEs under other names, so that both sets fit into one.
CF2 = CF.replace("b AS (", "b2 AS (").replace("k AS (", "k2 AS (").replace("JOIN b USING", "JOIN b2 USING").replace("JOIN k USING", "JOIN k2 USING")
add("M7", discount_curves,
    f"""WITH {CF2}, {PF}, ec AS {encoded_sql(CUSTOMER_INPUTS, 1)}, ep AS {encoded_sql(PRODUCT_INPUTS.format(d="dd", more=", (SELECT unnest([0, 5, 10, 15, 20, 25, 30]) / 100.0::DOUBLE AS dd)"), 2)},
    u AS (SELECT unnest(range(len(e))) AS pos, unnest(e) AS y FROM ec), mv AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(CAST(y AS DOUBLE)) AS m FROM u GROUP BY 1))
    SELECT product_id, discount, round(list_dot_product(CAST(e AS DOUBLE[]), m), 5) AS score FROM ep, mv""")



def examples(t: Tables) -> DataFrame:
    """Labelled pairs with the inputs of both encoders and four drawn products each; unknown customers and products have none."""
    people = cf(t).select("customer_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("age", "redemption_rate", "engagement", "sensitivity"))).alias("a"))
    goods = pf(t).select("product_id", F.coalesce("margin", F.lit(0.0)).alias("margin"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("margin", "popularity_score", "redemption_rate", "organic_ratio"))).alias("b"))
    goods, count = stage(goods.withColumn("k", F.row_number().over(Window.orderBy("product_id")) - 1), "goods"), t.products.count()  # catalogue-sized
    pairs = labelled_pairs(t).select("customer_id", "product_id", "offer", "label", "weight").where("customer_id IS NOT NULL AND product_id IS NOT NULL AND offer IS NOT NULL")
    drawn = F.array(*(F.floor(draw(9, "customer_id", "product_id", "offer", F.lit(i)) * count).cast("int") for i in range(4)))
    known = pairs.join(people, "customer_id").join(goods.drop("k"), "product_id")
    # the catalogue is sent once, as the columns of one row, instead of four joins of all examples
    every = goods.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("every"))
    negative = F.transform(drawn, lambda i: F.concat(F.get(F.col("every"), i), F.array(F.lit(0.0))))
    return known.crossJoin(F.broadcast(every)).select("customer_id", "product_id", "offer", "label", "weight", "margin", "a", F.concat("b", F.array("offer")).alias("b"), negative.alias("negatives"))  # one row


def trained(t: Tables, epochs: int = 4, batches: int = 3) -> DataFrame:
    """Loss and rate after each epoch of a small model's training."""
    rng = np.random.default_rng(5)

    def fresh(inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(rng.normal(0, 1 / np.sqrt(inputs), (inputs, HIDDEN)), np.zeros(HIDDEN)), (rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, OUT)), np.zeros(OUT))]

    model = training.train(examples(t), ["customer_id", "product_id", "offer"], fresh(4), fresh(5), epochs, batches, new_path(t.spark, "model"), 0.02)
    return t.spark.createDataFrame(model.epochs, "epoch int, loss double, rate double")


add("M5", trained)

#: Fixed values of the replications: runs, epochs, seed, chance of a visit, and the seasonal factor by month.
RUNS, EPOCHS, SEED, VISIT = 4, 12, 42, 0.15
SEASON = {0: 0.9, 1: 1.1, 2: 1.0}


def offers(t: Tables) -> DataFrame:
    """The three best products of each customer, as slots."""
    rows = t.recommendations.select("customer_id", "product_id", F.col("final_score").alias("score"), "category", F.lit(0.0).alias("margin"))
    none = rows.select("customer_id", "product_id").limit(0)
    return ranking.constrained_top(rows, none, none, 3).select("customer_id", F.col("place").alias("slot"), "score")


def replicated(t: Tables) -> DataFrame:
    month = F.expr("pmod(epoch div 4, 12)").cast("string")
    chance = 0.25 / (1 + F.exp(-7 * (F.col("score") - 0.45))) * lookup(month, {str(k): v for k, v in SEASON.items()}, 1.0)
    return replications.responses(offers(t), RUNS, EPOCHS, SEED, F.lit(VISIT), F.least(F.lit(1.0), chance))


OFFERS = """b AS (SELECT customer_id, product_id, max(final_score) AS s, arg_max(category, (final_score, category)) AS category FROM recommendations WHERE final_score IS NOT NULL AND NOT isnan(final_score) GROUP BY 1, 2),
    c AS (SELECT b.customer_id, b.product_id, CAST(s AS DOUBLE) AS score, (SELECT 1) AS one, category FROM b),
    p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) <= 15),
    q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY customer_id, category ORDER BY score DESC, product_id) <= 3),
    o AS (SELECT customer_id, score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS slot FROM q QUALIFY slot <= 3)"""
T14 = f"""WITH {OFFERS}, x AS (SELECT o.*, r.run, e.epoch FROM o, range({RUNS}) r(run), range({EPOCHS}) e(epoch)),
    y AS (SELECT *, CASE epoch // 4 % 12 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 ELSE 1.0 END AS season FROM x WHERE {draw_sql(str(SEED), "run", "epoch", "customer_id")} < {VISIT}::DOUBLE),
    z AS (SELECT run, epoch, slot, CAST({draw_sql(str(SEED + 1), "run", "epoch", "customer_id", "slot")} < least(1.0::DOUBLE, 0.25::DOUBLE / (1 + exp(-7 * (score - 0.45::DOUBLE))) * season) AS INTEGER) AS bought FROM y)
    SELECT CAST(run AS INTEGER) AS run, CAST(epoch AS INTEGER) AS epoch, count(*) FILTER (slot = 1) AS visitors, count(*) AS shown, CAST(sum(bought) AS BIGINT) AS purchases, sum(bought) / CAST(count(*) AS DOUBLE) AS share FROM z GROUP BY 1, 2"""
add("T-14", replicated, T14)
add("T-15", lambda t: rounded(series.bands(replicated(t), "epoch", "share"), "mean", "std", "low", "high"),
    f"WITH s AS (SELECT epoch, count(share) AS runs, avg(share) AS mean, stddev_pop(share) AS std FROM ({T14}) GROUP BY 1) SELECT epoch, runs, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - 1.96 * std / sqrt(runs), 6) AS low, round(mean + 1.96 * std / sqrt(runs), 6) AS high FROM s")


def pages(t: Tables) -> DataFrame:
    """Stores written as web pages and read back: every third with its coordinates in a tag, every fifth as a list in an attribute, every seventh twice, as a second block of its page."""
    s = t.stores
    data = F.to_json(F.struct(F.col("name").alias("name"), F.col("phone").alias("telephone"), F.struct(F.col("address").alias("streetAddress"), F.col("city").alias("addressLocality"), F.col("state").alias("addressRegion"), F.col("zip_code").alias("postalCode")).alias("address"),
                              F.when(F.col("store_id") % 3 != 0, F.struct(F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude"))).alias("geo")))
    tag = F.when(F.col("store_id") % 3 == 0, F.concat(F.lit('<meta name="geo.position" content="'), F.coalesce(F.concat_ws(";", F.col("latitude").cast("string"), F.col("longitude").cast("string")), F.lit("")), F.lit('">'))).otherwise("")
    block = F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))
    other = F.when(F.col("store_id") % 7 == 0, F.concat(F.lit('<script type="application/ld+json">['), F.regexp_replace(data, r'"name":"', '"name":"second '), F.lit("]</script>"))).otherwise("")
    listed = F.struct(F.array(F.struct(F.col("store_id").cast("string").alias("storeNumber"), F.struct(F.col("address").alias("firstLine"), F.concat_ws(", ", "city", F.coalesce("state", F.lit("")), "zip_code").alias("secondLine")).alias("address"),
                                       F.struct(F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lng")).alias("mapPin"))).alias("storeResult"))
    attribute = F.when(F.col("store_id") % 5 == 0, F.concat(F.lit(f'<p {ATTRIBUTE}="'), F.replace(F.replace(F.to_json(listed), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"></p>'))).otherwise("")
    html = F.concat(F.lit("<html><head>"), tag, F.lit("</head>"), attribute, block, other, F.lit("</html>"))
    return store_pages(s.select("store_id", html.alias("html")), "store_id", "html").select("store_id", "name", "latitude", "longitude", "state")


add("S22", pages, """WITH w AS (SELECT * FROM stores WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND (latitude <> 0 OR longitude <> 0) AND address <> '')
    SELECT store_id, CASE WHEN store_id % 5 <> 0 THEN trim(name) END AS name, latitude, longitude, CASE WHEN store_id % 5 = 0 THEN nullif(upper(trim(state)), '') ELSE upper(trim(state)) END AS state FROM w
    UNION ALL SELECT store_id, 'second ' || trim(name, '') AS name, latitude, longitude, upper(trim(state)) FROM w WHERE store_id % 7 = 0 AND store_id % 5 <> 0""".replace("'second ' || trim(name, '')", "trim('second ' || name)"))

QUERIES, SQL = BOOK.queries, BOOK.sql
