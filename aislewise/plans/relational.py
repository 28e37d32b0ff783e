"""Sources and sinks, projections, joins, sorting, sets and scalar functions (S, P, J, L, U, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions import scalar
from aislewise.operators import elasticity, features
from aislewise.plans.analytics import CF, PF, cf, draw_sql, levels, pf
from aislewise.plans.common import Book, Tables
from aislewise.sources import files
from aislewise.staging import new_path, stage

BOOK = Book()
add, both = BOOK.add, BOOK.both
STORE_SCHEMA = "store_id int, name string, state string, latitude double"
STORE_SQL = "SELECT store_id, name, state, latitude FROM stores"

# ---- sources and sinks


def stores(t: Tables) -> DataFrame:
    return t.stores.select("store_id", "name", "state", "latitude")


def csv_with_cut_line(t: Tables) -> DataFrame:
    """Stores written as compressed CSV beside a file whose last line is cut short, read back by a glob."""
    path = new_path(t.spark, "csv")
    files.write_csv(stores(t), f"{path}/whole", "gzip")
    t.spark.createDataFrame([("store_id,name,state,latitude",), ("9x",)], "value string").coalesce(1).write.text(f"{path}/cut")
    return files.read_csv(t.spark, [f"{path}/whole", f"{path}/cut"], STORE_SCHEMA).where("store_id IS NOT NULL")


def detected(t: Tables) -> DataFrame:
    """Both formats below one folder: Parquet is taken, and CSV where it is alone."""
    path = new_path(t.spark, "detect")
    files.write_parquet(stores(t), f"{path}/both")
    files.write_csv(stores(t).limit(1), f"{path}/both_csv")
    files.write_csv(stores(t), f"{path}/csv")
    a = files.read_detected(t.spark, f"{path}/both", STORE_SCHEMA).withColumn("kind", F.lit(files.detect_format(t.spark, f"{path}/both")[0]))
    b = files.read_detected(t.spark, f"{path}/csv", STORE_SCHEMA).withColumn("kind", F.lit(files.detect_format(t.spark, f"{path}/csv")[0]))
    return a.unionByName(b)


def external_view(t: Tables) -> DataFrame:
    t.transactions.createOrReplaceTempView("aislewise_transactions")
    return t.spark.sql("SELECT store_id, count(*) AS n FROM aislewise_transactions GROUP BY store_id")


def catalog(t: Tables) -> DataFrame:
    for name in ("stores", "products"):
        getattr(t, name).createOrReplaceTempView(f"aislewise_{name}")
    there = [(n, t.spark.catalog.tableExists(f"aislewise_{n}")) for n in ("stores", "products", "nowhere")]
    return t.spark.createDataFrame(there, "name string, present boolean")


def reused(t: Tables) -> DataFrame:
    path = new_path(t.spark, "reused")
    _, first = files.ensure_parquet(t.spark, path, lambda: stores(t))
    df, second = files.ensure_parquet(t.spark, path, lambda: stores(t).limit(0))
    return df.select("*", F.lit(first).alias("built"), F.lit(second).alias("again"))


def created_table(t: Tables) -> DataFrame:
    """CREATE OR REPLACE of a managed-by-path table: the second writing replaces the first."""
    path = new_path(t.spark, "ctas")
    files.write_parquet(stores(t).limit(5), path, mode="overwrite")
    files.write_parquet(stores(t), path, mode="overwrite")
    return files.read_parquet(t.spark, path)


def appended(t: Tables) -> DataFrame:
    path = new_path(t.spark, "append")
    for low, high in ((0, 100), (100, 200), (200, 1000)):
        files.write_parquet(stores(t).where((F.col("store_id") >= low) & (F.col("store_id") < high)), path, mode="append")
    return files.read_parquet(t.spark, path, STORE_SCHEMA)


def binary_vectors(t: Tables) -> DataFrame:
    """All vectors through the binary file layout, a file per partition; the files lie in the shared folder where that is mounted."""
    path = new_path(t.spark, "vectors")
    if not path.startswith("file:") and "://" in path:
        raise ValueError("the binary layout needs a mounted folder")
    written = files.write_vector_files(t.embeddings, path.replace("file://", "").replace("file:", ""), "vec_id", "embedding")
    return files.read_vector_file(t.spark, written).select("id", F.posexplode("vector").alias("pos", "x"))


def numpy_arrays(t: Tables) -> DataFrame:
    """All vectors through NPZ files, a file per partition."""
    path = new_path(t.spark, "arrays")
    if not path.startswith("file:") and "://" in path:
        raise ValueError("the executors write array files to a mounted folder")
    written = files.write_npz_files(t.embeddings, path.replace("file://", "").replace("file:", ""), "vec_id", "embedding")
    return files.read_npz_files(t.spark, [f"file://{p}" for p in written]).select("id", F.posexplode("vector").alias("pos", "x"))


def converted(t: Tables) -> DataFrame:
    path = new_path(t.spark, "convert")
    files.write_csv(stores(t), f"{path}/a")
    files.write_csv(stores(t).limit(0), f"{path}/b")
    for _ in range(2):  # the second call skips what is done
        out = files.convert_csv(t.spark, [f"{path}/a", f"{path}/b"], f"{path}/out", STORE_SCHEMA)
    return files.read_parquet(t.spark, out, STORE_SCHEMA)


add("S1", lambda t: files.read_parquet(t.spark, f"{t.sf_dir}/products.parquet", "product_id int, name string, category string, price double"), "SELECT product_id, name, category, price FROM products")
add("S2", lambda t: files.read_parquet(t.spark, f"{t.sf_dir}/coupon_cli*.parquet").select("clip_id", "clip_date", "redeemed"), "SELECT clip_id, clip_date, redeemed FROM coupon_clips")
add("S3", csv_with_cut_line, STORE_SQL)
add("S4", detected, "SELECT store_id, name, state, latitude, kind FROM stores, (VALUES ('parquet'), ('csv')) k(kind)")
add("S5", external_view, "SELECT store_id, count(*) AS n FROM transactions GROUP BY 1")
both("S6", "SELECT store_id, name, CAST(latitude AS DOUBLE) AS latitude FROM (VALUES (1, 'Main', 40.5), (2, 'Oak', 41.25), (3, 'Elm', 42.0)) AS s(store_id, name, latitude)")
add("S7", catalog, "SELECT * FROM (VALUES ('stores', true), ('products', true), ('nowhere', false)) v(name, present)")
add("S8", reused, "SELECT store_id, name, state, latitude, true AS built, false AS again FROM stores")
add("S9", created_table, STORE_SQL)
add("S10", appended, STORE_SQL)
add("S11", lambda t: stage(pf(t), "features").select("product_id", "units", "revenue"), f"WITH {PF} SELECT product_id, units, revenue FROM pf")
add("S12", lambda t: files.read_parquet(t.spark, files.write_parquet(stores(t), new_path(t.spark, "snappy"), "snappy"), STORE_SCHEMA), STORE_SQL)
add("S13", converted, STORE_SQL)
add("S14", lambda t: files.read_parquet(t.spark, files.write_parquet(t.recommendations.select("customer_id", "product_id", "category"), new_path(t.spark, "parts"), "zstd", ["category"])).select("customer_id", "product_id", "category"),
    "SELECT customer_id, product_id, category FROM recommendations")
add("S15", lambda t: files.read_csv(t.spark, files.write_csv(stores(t), new_path(t.spark, "csv")), STORE_SCHEMA), STORE_SQL)
add("S16", lambda t: files.json_lines(t.stores.groupBy("state").agg(F.count(F.lit(1)).alias("n")).where("state IS NOT NULL").select("state", "n")),
    """SELECT '{"state":"' || state || '","n":' || count(*) || '}' AS json FROM stores WHERE state IS NOT NULL GROUP BY state""")
add("S17", numpy_arrays, "SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings")
add("S18", binary_vectors, "SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings")
add("S20", lambda t: t.spark.createDataFrame(t.stores.select("store_id", "name").toPandas()).select(F.col("store_id").cast("int").alias("store_id"), "name"), "SELECT store_id, name FROM stores")
add("S21", lambda t: t.spark.createDataFrame([(t.transactions.count(),)], "n bigint"), "SELECT count(*) AS n FROM transactions")
add("S23", lambda t: files.first_by_id(stores(t).withColumn("arrival", F.lit(1)).unionByName(stores(t).withColumns({"arrival": F.lit(2), "name": F.lit("later")})), "store_id", ["arrival"]),
    "SELECT store_id, name, state, latitude, 1 AS arrival FROM stores")

# ---- projection, filter, predicates

OFFERS = "FROM coupon_clips c JOIN products p ON p.product_id = c.product_id"


def offers(t: Tables) -> DataFrame:
    return t.coupon_clips.join(t.products.select("product_id", "price"), "product_id")


add("P1", lambda t: t.products.select("product_id", scalar.margin(F.col("price"), F.col("unit_cost")).alias("margin")), "SELECT product_id, (price - unit_cost) / nullif(price, 0) AS margin FROM products")
both("P2", "SELECT p.product_id, coalesce(n, 0) AS n FROM {products} p LEFT JOIN (SELECT product_id, count(*) AS n FROM {coupon_clips} GROUP BY product_id) c ON c.product_id = p.product_id")
both("P3", "SELECT product_id, CASE WHEN price >= 20 THEN 'high' WHEN price >= 8 THEN 'middle' WHEN price > 0 THEN 'low' ELSE 'none' END AS band FROM {products}")
add("P4", lambda t: t.transactions.groupBy(scalar.bucket(F.coalesce("discount_pct", F.lit(0.0)), [0.05, 0.10, 0.15, 0.20]).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN coalesce(discount_pct, 0) < 0.05 THEN 0 WHEN discount_pct < 0.10 THEN 1 WHEN discount_pct < 0.15 THEN 2 WHEN discount_pct < 0.20 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM transactions GROUP BY 1")
add("P5", lambda t: offers(t).select("clip_id", elasticity.capped_discount("discount_type", "discount_value", "price", 0.5, 0.1).alias("offer")),
    f"SELECT clip_id, CASE discount_type WHEN 'percent_off' THEN least(discount_value, 0.5) WHEN 'bogo' THEN 0.5 WHEN 'dollar_off' THEN least(discount_value / nullif(price, 0), 0.5) ELSE 0.1 END AS offer {OFFERS}")
add("P6", lambda t: offers(t).select("clip_id", elasticity.effective_discount("discount_type", "discount_value", "price").alias("offer")),
    f"SELECT clip_id, CASE discount_type WHEN 'dollar_off' THEN least(discount_value / nullif(price, 0), 0.6) WHEN 'bogo' THEN 0.5 ELSE discount_value END AS offer {OFFERS}")
both("P7", "SELECT gender, count(*) AS n FROM {customers} GROUP BY gender ORDER BY CASE gender WHEN 'NB' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, gender NULLS LAST LIMIT 3")
both("P8", "SELECT product_id, price FROM {products} WHERE is_rx = false AND (price IS NULL OR price <= 0 OR unit_cost > price)")
both("P9", "SELECT transaction_id, customer_id, total FROM {transactions} WHERE customer_id >= 100 AND customer_id < 200")
add("P10", lambda t: t.stores.select("store_id", F.col("zip_code").try_cast("int").alias("zip"), F.col("store_id").cast("string").alias("id")), "SELECT store_id, TRY_CAST(zip_code AS INTEGER) AS zip, CAST(store_id AS VARCHAR) AS id FROM stores")
both("P11", "SELECT (SELECT count(*) FROM {stores}) AS stores, (SELECT count(*) FROM {products}) AS products, (SELECT count(DISTINCT loyalty_number) FROM {coupon_clips}) AS clippers, (SELECT count(*) FROM {coupon_clips} WHERE redeemed) AS redeemed")
both("P12", "WITH c AS (SELECT avg(age) AS mean FROM {customers}) SELECT customer_id, CASE WHEN age >= (SELECT mean FROM c) THEN 'older' ELSE 'younger' END AS half FROM {customers} WHERE age IS NOT NULL")
add("P13", lambda t: features.with_quantiles(t.products.where("price > 0").select("product_id", "price"), {"low": ("price", 0.3), "high": ("price", 0.7)}).select("product_id", F.when(F.col("price") >= F.col("high"), "high").when(F.col("price") >= F.col("low"), "middle").otherwise("low").alias("band")),
    "WITH c AS (SELECT quantile_cont(price, 0.3) AS low, quantile_cont(price, 0.7) AS high FROM products WHERE price > 0) SELECT product_id, CASE WHEN price >= high THEN 'high' WHEN price >= low THEN 'middle' ELSE 'low' END AS band FROM products, c WHERE price > 0")
both("P14", "SELECT product_id, price - unit_cost AS gap FROM {products} WHERE price > 0 ORDER BY price - unit_cost DESC, product_id LIMIT 30")
add("P15", lambda t: pf(t).select("product_id", F.round(F.col("units") * F.col("margin") * (1 + F.col("clip_rate") * 0.5), 6).alias("score")), f"WITH {PF} SELECT product_id, round(units * margin * (1 + clip_rate * 0.5::DOUBLE), 6) AS score FROM pf")
add("P16", lambda t: t.customers.select("customer_id", scalar.lookup(F.col("gender"), {"F": 0, "M": 1, "NB": 2}, -1).alias("gender_id")), "SELECT customer_id, CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'NB' THEN 2 ELSE -1 END AS gender_id FROM customers")


def zscores(t: Tables) -> DataFrame:
    one = t.customers.agg(F.avg("age").alias("m"), F.stddev_samp("age").alias("s"))
    return t.customers.crossJoin(F.broadcast(one)).select("customer_id", F.round(scalar.zscore(F.col("age"), F.col("m"), F.col("s")), 6).alias("z"))  # one row


add("P17", zscores, "SELECT customer_id, round((age - m) / greatest(s, 1e-8), 6) AS z FROM customers, (SELECT avg(age) AS m, stddev_samp(age) AS s FROM customers)")
add("P18", lambda t: t.customers.select("customer_id", *(F.when(F.col("gender") == g, 1.0).otherwise(0.0).alias(f"is_{g.lower()}") for g in ("F", "M", "NB"))),
    "SELECT customer_id, CASE gender WHEN 'F' THEN 1.0::DOUBLE ELSE 0 END AS is_f, CASE gender WHEN 'M' THEN 1.0::DOUBLE ELSE 0 END AS is_m, CASE gender WHEN 'NB' THEN 1.0::DOUBLE ELSE 0 END AS is_nb FROM customers")
add("F30", lambda t: t.recommendations.where("raw_score IS NOT NULL").select(F.round(F.avg(scalar.bce_with_logits(F.col("raw_score").cast("double"), F.when(F.col("rank") <= 5, 1.0).otherwise(0.0))), 6).alias("loss")),
    "SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss FROM (SELECT CAST(raw_score AS DOUBLE) AS x, CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS y FROM recommendations WHERE raw_score IS NOT NULL)")
both("M2", """SELECT round(sum(w * (l + ln(2))) / sum(w), 6) AS loss FROM (SELECT (0.5 + least(greatest(margin_pct, 0), 0.75) / 0.75) * CASE WHEN rank <= 5 THEN 1 ELSE 0.5 END AS w,
    greatest(x, 0) - x * CASE WHEN rank <= 5 THEN 1 ELSE 0 END + ln(1 + exp(-abs(x))) AS l FROM (SELECT CAST(raw_score AS DOUBLE) AS x, rank, CAST(margin_pct AS DOUBLE) AS margin_pct FROM {recommendations} WHERE raw_score IS NOT NULL AND margin_pct IS NOT NULL AND rank IS NOT NULL) y) z""")

# ---- joins

both("J1", "SELECT clip_id, c.product_id, category FROM {coupon_clips} c JOIN {products} p ON p.product_id = c.product_id")
both("J2", "SELECT clip_id, customer_id FROM {coupon_clips} c JOIN {customers} u ON u.loyalty_number = c.loyalty_number")
both("J3", "SELECT t.transaction_id, p.category, s.state, u.age FROM {transactions} t JOIN {products} p ON p.product_id = t.product_id JOIN {stores} s ON s.store_id = t.store_id JOIN {customers} u ON u.customer_id = t.customer_id")
add("J4", lambda t: cf(t).select("customer_id", "transactions", "clips"), f"WITH {CF} SELECT customer_id, transactions, clips FROM cf")
both("J5", "SELECT a.transaction_id, a.loaded_at AS first_load, b.loaded_at AS later_load FROM {transactions} a JOIN {transactions} b ON a.transaction_id = b.transaction_id AND a.loaded_at < b.loaded_at")
both("J6", "SELECT t.transaction_id, n AS basket FROM {transactions} t JOIN (SELECT customer_id, date, count(*) AS n FROM {transactions} GROUP BY customer_id, date) b ON b.customer_id = t.customer_id AND b.date = t.date")
both("J7", "SELECT DISTINCT t.product_id FROM {transactions} t LEFT ANTI JOIN {products} p ON p.product_id = t.product_id WHERE t.product_id IS NOT NULL")
BOOK.sql["J7"] = "SELECT DISTINCT t.product_id FROM transactions t ANTI JOIN products p ON p.product_id = t.product_id WHERE t.product_id IS NOT NULL"
both("J8", "SELECT p.product_id, sku, n FROM {products} p LEFT JOIN (SELECT product_id, count(*) AS n FROM {recommendations} GROUP BY product_id) r ON r.product_id = p.product_id")
both("J9", "SELECT a.product_id, a.n AS sold, b.n AS clipped FROM (SELECT product_id, count(*) AS n FROM {transactions} GROUP BY product_id) a JOIN (SELECT product_id, count(*) AS n FROM {coupon_clips} GROUP BY product_id) b ON a.product_id = b.product_id")
both("J10", "SELECT s.store_id, s.state, n FROM {stores} s JOIN (SELECT state, count(*) AS n FROM {customers} GROUP BY state) m ON m.state = s.state")

# ---- sort, limit, sampling: hash samples are the same in every run

both("L1", f"SELECT product_id, count(*) AS n FROM {{transactions}} WHERE product_id IS NOT NULL GROUP BY product_id ORDER BY n DESC, product_id LIMIT 25")


both("L2", "SELECT customer_id, state, age FROM {customers} ORDER BY customer_id LIMIT 40 OFFSET 50")

# draws by MD5 of seed and key: the same rows in every run and engine, whatever the partitioning
add("L6", lambda t: t.transactions.select("transaction_id", "product_id").where(scalar.draw(42, "transaction_id") < 0.1), f"SELECT transaction_id, product_id FROM transactions WHERE {draw_sql(42, 'transaction_id')} < 0.1")
BLOCK_ROWS = 256
add("L7", lambda t: t.transactions.select("transaction_id", "product_id").where(scalar.draw(42, F.expr(f"transaction_id div {BLOCK_ROWS}")) < 0.1).orderBy("transaction_id", "product_id").limit(1000),
    f"SELECT transaction_id, product_id FROM transactions WHERE {draw_sql(42, f'(transaction_id // {BLOCK_ROWS})')} < 0.1 ORDER BY transaction_id, product_id NULLS FIRST LIMIT 1000")
add("L8", lambda t: t.customers.select("customer_id", "age").orderBy(scalar.draw(42, "customer_id"), "customer_id").limit(100), f"SELECT customer_id, age FROM customers ORDER BY {draw_sql(42, 'customer_id')}, customer_id LIMIT 100")
add("L9", lambda t: t.coupon_clips.select("clip_id", "product_id").where(scalar.draw(42, "clip_id", "product_id") < 0.3), f"SELECT clip_id, product_id FROM coupon_clips WHERE {draw_sql(42, 'clip_id', 'product_id')} < 0.3")
add("L10", lambda t: t.products.select("product_id").orderBy(scalar.draw(7, "product_id"), "product_id").limit(500), f"SELECT product_id FROM products ORDER BY {draw_sql(7, 'product_id')}, product_id LIMIT 500")
both("U1", "SELECT product_id, 'clip' AS kind, count(*) AS n FROM {coupon_clips} GROUP BY product_id UNION ALL SELECT CAST(product_id AS INT), 'sale', count(*) FROM {transactions} GROUP BY product_id UNION ALL SELECT product_id, 'offer', count(*) FROM {recommendations} GROUP BY product_id")
both("U2", "SELECT product_id FROM {transactions} EXCEPT SELECT CAST(product_id AS BIGINT) FROM {products}")
both("U3", "SELECT DISTINCT category, brand FROM {products}")
add("U4", lambda t: t.products.select("product_id", F.lit("a").alias("part")).orderBy(scalar.draw(1, "product_id"), "product_id").limit(70).unionByName(t.products.select("product_id", F.lit("b").alias("part")).orderBy(scalar.draw(2, "product_id"), "product_id").limit(30)),
    " UNION ALL ".join(f"(SELECT product_id, '{p}' AS part FROM products ORDER BY {draw_sql(i, 'product_id')}, product_id LIMIT {n})" for p, i, n in (("a", 1, 70), ("b", 2, 30))))


def labelled_pairs(t: Tables) -> DataFrame:
    """Labelled (customer, product) examples: coupon responses, discounted and organic purchases, with weights."""
    clips = t.coupon_clips.join(t.products.select("product_id", "price"), "product_id").join(t.customers.select("loyalty_number", "customer_id"), "loyalty_number")
    coupon = clips.select(F.col("customer_id").cast("bigint").alias("customer_id"), F.col("product_id").cast("bigint").alias("product_id"), elasticity.capped_discount("discount_type", "discount_value", "price", 0.5, 0.1).alias("offer"), F.when(F.col("redeemed"), 1.0).otherwise(0.0).alias("label"), F.lit(1.0).alias("weight"))
    bought = t.transactions.select("customer_id", "product_id", F.col("discount_pct").alias("offer"), F.lit(1.0).alias("label"), F.when(F.col("discount_pct") > 0, 1.0).otherwise(0.5).alias("weight"))
    return coupon.unionByName(bought.where("offer >= 0"))


add("M3", labelled_pairs, """SELECT CAST(u.customer_id AS BIGINT) AS customer_id, CAST(c.product_id AS BIGINT) AS product_id, CASE discount_type WHEN 'percent_off' THEN least(discount_value, 0.5) WHEN 'bogo' THEN 0.5 WHEN 'dollar_off' THEN least(discount_value / nullif(price, 0), 0.5) ELSE 0.1 END AS offer,
      CASE WHEN redeemed THEN 1.0::DOUBLE ELSE 0 END AS label, 1.0::DOUBLE AS weight FROM coupon_clips c JOIN products p ON p.product_id = c.product_id JOIN customers u ON u.loyalty_number = c.loyalty_number
    UNION ALL SELECT customer_id, product_id, discount_pct, 1.0, CASE WHEN discount_pct > 0 THEN 1.0::DOUBLE ELSE 0.5 END FROM transactions WHERE discount_pct >= 0""")


def negatives(t: Tables) -> DataFrame:
    """Four products per customer, drawn by seed, customer and number over the numbered catalogue."""
    numbered = t.products.select("product_id").withColumn("k", F.row_number().over(Window.orderBy("product_id")) - 1)  # catalogue-sized
    count = t.products.count()
    draws = t.customers.select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("draw")).withColumn("k", F.floor(scalar.draw(42, "customer_id", "draw") * count).cast("int"))
    return draws.join(numbered, "k").select("customer_id", "draw", "product_id")


add("M4", negatives, f"""WITH n AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS k, count(*) OVER () AS c FROM products), d AS (SELECT customer_id, CAST(draw AS INTEGER) AS draw FROM customers, range(1, 5) r(draw))
    SELECT customer_id, draw, product_id FROM d JOIN n ON k = floor({draw_sql(42, "customer_id", "draw")} * c)""")
add("P17_vocabulary", lambda t: features.vocabulary(t.products, "category"), "SELECT category AS value, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS id FROM (SELECT DISTINCT category FROM products WHERE category IS NOT NULL)")

# ---- scalar functions

both("F1", "SELECT clip_id, least(discount_value, 0.5) AS capped, greatest(discount_value, 0.5) AS floored FROM {coupon_clips}")
both("F2", "SELECT transaction_id, CAST(round(CAST(total AS DECIMAL(18,2)) * 3, 1) AS DOUBLE) AS r FROM {transactions}")  # totals are in cents; ties away from zero
both("F3", "SELECT product_id, nullif(price, 0) AS price FROM {products}")
both("F4", "SELECT customer_id, coalesce(state, 'unknown') AS state, CAST(coalesce(age, 0) AS INT) AS age FROM {customers}")
add("F5", lambda t: t.customers.select("customer_id", (scalar.draw(7, "customer_id") < 0.5).alias("half")), f"SELECT customer_id, {draw_sql(7, 'customer_id')} < 0.5 AS half FROM customers")
both("F6", "SELECT product_id, round(ln(greatest(price, 1e-6)), 9) AS log_price FROM {products} WHERE price IS NOT NULL")
both("F7", "SELECT product_id, round(exp(-popularity_score * 2), 9) AS decay FROM {products}")
both("F8", "SELECT product_id, round(sqrt(units), 9) AS weight, round(sqrt(popularity_score), 9) AS root FROM (SELECT p.product_id, popularity_score, count(t.product_id) AS units FROM {products} p LEFT JOIN {transactions} t ON t.product_id = p.product_id GROUP BY p.product_id, popularity_score) x")
add("F9", lambda t: t.products.select("product_id", scalar.clip(F.col("popularity_score"), 0.2, 0.8).alias("x")), "SELECT product_id, greatest(0.2, least(popularity_score, 0.8)) AS x FROM products")
both("F10", "SELECT transaction_id, abs(quantity) AS q, greatest(0, quantity) AS positive FROM {transactions}")
add("F11", lambda t: t.products.select("product_id", F.round(scalar.sigmoid(F.col("popularity_score") * 7 - 3), 9).alias("p")), "SELECT product_id, round(1 / (1 + exp(-(popularity_score * 7 - 3))), 9) AS p FROM products")
both("F12", "SELECT product_id, round(1 - power(1 - popularity_score, 52), 9) AS yearly FROM {products}")


def least_squares(t: Tables) -> DataFrame:
    """Slope and intercept of redemption on discount per category, by the closed form of the 2 x 2 normal equations."""
    points = levels(t).where("level IS NOT NULL AND category IS NOT NULL").withColumn("y", F.col("redeemed") / F.col("clips"))
    return points.groupBy("category").agg(F.round(F.regr_slope("y", "level"), 3).alias("slope"), F.round(F.regr_intercept("y", "level"), 3).alias("intercept"))


add("F14", least_squares, """WITH l AS (SELECT category, CAST(round(CAST(CASE discount_type WHEN 'dollar_off' THEN least(discount_value / nullif(price, 0), 0.6) WHEN 'bogo' THEN 0.5 ELSE discount_value END AS DECIMAL(18,6)), 2) AS DOUBLE) AS level, c.product_id, count(*) AS n, count(*) FILTER (redeemed) AS r
      FROM coupon_clips c JOIN products p ON p.product_id = c.product_id GROUP BY 1, 2, 3)
    SELECT category, round(regr_slope(r / CAST(n AS DOUBLE), level), 3) AS slope, round(regr_intercept(r / CAST(n AS DOUBLE), level), 3) AS intercept FROM l WHERE level IS NOT NULL AND category IS NOT NULL GROUP BY 1""")
both("F15", "SELECT CAST(date_trunc('month', clip_date) AS DATE) AS month, count(*) AS n FROM {coupon_clips} GROUP BY CAST(date_trunc('month', clip_date) AS DATE)")
both("F16", "SELECT min(date) AS first_day, max(date) AS last_day, min(date) >= DATE '2024-01-01' AND max(date) <= DATE '2025-12-31' AS inside FROM {transactions}")
add("F17", lambda t: t.coupon_clips.select("clip_id", F.date_add("clip_date", 14).alias("due"), F.datediff("expiration_date", "clip_date").alias("open_days")), "SELECT clip_id, CAST(clip_date + 14 AS DATE) AS due, CAST(expiration_date - clip_date AS INTEGER) AS open_days FROM coupon_clips")
add("F18", lambda t: t.spark.range(60).select(F.col("id").alias("epoch"), F.expr("pmod(id div 4, 12)").alias("month")), "SELECT epoch, epoch // 4 % 12 AS month FROM range(60) r(epoch)")
add("F19", lambda t: t.customers.select("customer_id", scalar.card_number(F.col("customer_id")).alias("card")), "SELECT customer_id, printf('EC%010d', customer_id) AS card FROM customers")
both("F20", "SELECT customer_id, concat(lower(first_name), '.', lower(last_name), CAST(customer_id % 100 AS STRING)) AS name FROM {customers} WHERE first_name IS NOT NULL AND last_name IS NOT NULL")
BOOK.sql["F20"] = BOOK.sql["F20"].replace("STRING", "VARCHAR")
add("F21", lambda t: t.stores.select("store_id", F.split("address", " ")[0].alias("number"), F.upper(F.trim("city")).alias("city"), scalar.title(F.col("address")).alias("title")),
    r"SELECT store_id, split_part(address, ' ', 1) AS number, upper(trim(city)) AS city, array_to_string(list_transform(regexp_extract_all(address, '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM stores")
add("F22", lambda t: t.stores.select("store_id", scalar.phone(F.col("phone")).alias("phone")),
    "WITH d AS (SELECT store_id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM stores) SELECT store_id, CASE WHEN length(d) >= 10 THEN '(' || substr(right(d, 10), 1, 3) || ') ' || substr(right(d, 10), 4, 3) || '-' || right(d, 4) END AS phone FROM d")
add("F23", lambda t: t.stores.select("store_id", scalar.zip5(F.col("zip_code")).alias("zip")), "SELECT store_id, lpad(substr(trim(split_part(trim(zip_code), '-', 1)), 1, 5), 5, '0') AS zip FROM stores")
D10 = "rpad(substr(regexp_replace(md5(sku), '[^0-9]', '', 'g'), 1, {n}), {n}, '0')"
add("F24", lambda t: t.products.select("product_id", scalar.upc(F.col("sku")).alias("upc")),
    f"WITH c AS (SELECT product_id, '0' || {D10.format(n=10)} AS c FROM products) SELECT product_id, c || CAST((10 - (" + " + ".join(f"CAST(substr(c, {i + 1}, 1) AS INTEGER) * {3 if i % 2 == 0 else 1}" for i in range(11)) + ") % 10) % 10 AS VARCHAR) AS upc FROM c")
add("F25", lambda t: t.products.select("product_id", scalar.ndc(F.col("sku")).alias("ndc")), f"WITH c AS (SELECT product_id, {D10.format(n=11)} AS d FROM products) SELECT product_id, substr(d, 1, 5) || '-' || substr(d, 6, 4) || '-' || substr(d, 10, 2) AS ndc FROM c")
add("F26", lambda t: t.products.select("product_id", F.when(F.col("sku").startswith("07"), "pack").when(F.col("sku").startswith("0"), "single").otherwise("other").alias("label")), "SELECT product_id, CASE WHEN sku LIKE '07%' THEN 'pack' WHEN sku LIKE '0%' THEN 'single' ELSE 'other' END AS label FROM products")
E2 = "CAST(embedding AS DOUBLE[])"
add("F27", lambda t: t.embeddings.select("vec_id", F.round(scalar.norm(F.col("embedding")), 6).alias("norm")), f"SELECT vec_id, round(sqrt(list_dot_product({E2}, {E2})), 6) AS norm FROM embeddings")


def against_first(t: Tables) -> DataFrame:
    first = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("e0"))
    return t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", "label", F.round(scalar.dot(F.col("embedding"), F.col("e0")), 6).alias("dot"))  # one row


add("F28", against_first, f"SELECT a.vec_id, a.label, round(list_dot_product({E2.replace('embedding', 'a.embedding')}, {E2.replace('embedding', 'b.embedding')}), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id = 0")
add("F29", lambda t: against_first(t).where("vec_id <> 0").groupBy("label").agg(F.max_by("vec_id", F.struct("dot", -F.col("vec_id"))).alias("best")),
    f"SELECT label, arg_max(vec_id, (dot, -vec_id)) AS best FROM ({BOOK.sql['F28']}) WHERE vec_id <> 0 GROUP BY 1")
add("F31", lambda t: t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.k").alias("text")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS text FROM events")
add("F32", lambda t: t.stores.where("latitude IS NOT NULL").select("store_id", F.concat(F.lit("$"), F.format_number(F.col("store_id") * 1234, 0)).alias("money"), F.format_string("%05d", "store_id").alias("padded")),
    "SELECT store_id, '$' || format('{:,}', store_id * 1234) AS money, printf('%05d', store_id) AS padded FROM stores WHERE latitude IS NOT NULL")

QUERIES, SQL = BOOK.queries, BOOK.sql
