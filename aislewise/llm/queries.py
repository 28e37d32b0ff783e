"""Queries of this subpackage, with SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm.cooccurrence import cooccurrence
from aislewise.llm.distinct import estimates, sketch, sparse_groups
from aislewise.llm.encode import encode_corpus
from aislewise.llm.leakage import leaked_items
from aislewise.llm.splitting import split_oversized
from aislewise.llm.topn import top_n
from aislewise.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "recommendations", "customer_id", "product_id", "final_score")
    return top_n(rows, "customer_id", "final_score", "product_id", 10).select("customer_id", "product_id", "place")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence(table(spark, sf_dir, "transactions", "customer_id", "date", "product_id"), ["customer_id", "date"], "product_id", min_share=0.006)
    return pairs.where("together * baskets >= 3 * baskets_a * baskets_b").select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p3_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in at least 0.05% of all baskets, with their counts and lift."""
    pairs = cooccurrence(table(spark, sf_dir, "transactions", "customer_id", "date", "product_id"), ["customer_id", "date"], "product_id", min_share=0.0005)
    return pairs.withColumnsRenamed({"item_a": "product_a", "item_b": "product_b"})


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in at least one basket, with their counts and lift."""
    pairs = cooccurrence(table(spark, sf_dir, "transactions", "customer_id", "date", "product_id"), ["customer_id", "date"], "product_id")
    return pairs.withColumnsRenamed({"item_a": "product_a", "item_b": "product_b"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "transactions", "transaction_id", "customer_id", "date", "product_id")
    return sparse_groups(rows, ["date", "product_id"], "transaction_id", "customer_id", 10, 6)


_KEYS, _ITEMS = ("date", "store_id", "product_id"), ("customer_id", "product_id")
_SETS = [[k for i, k in enumerate(_KEYS) if bits >> i & 1] for bits in range(1, 8)]


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated customers and products per date, store, product and combination of these, with 95% intervals."""
    rows = table(spark, sf_dir, "transactions", "customer_id", "date", "store_id", "product_id")
    return estimates(sketch(rows, _SETS, _ITEMS))


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_counts against exact counts: per set and item the groups, and whether no more of them lie outside their interval than one in twenty (and four deviations)."""
    rows = table(spark, sf_dir, "transactions", "customer_id", "date", "store_id", "product_id")
    exact = None
    for keys in _SETS:
        for item in _ITEMS:
            own = rows.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col(item).alias("x")).dropna().distinct().groupBy(*(f"k_{k}" for k in keys)).agg(F.count(F.lit(1)).alias("n"))
            part = own.select(F.lit("+".join(keys)).alias("grouping"), F.lit(item).alias("item"), F.concat_ws("|", *(F.col(f"k_{k}").cast("string") for k in keys)).alias("g"), "n")
            exact = part if exact is None else exact.unionByName(part)
    seen = p4_counts(spark, sf_dir).withColumn("g", F.concat_ws("|", *(F.col(k).cast("string") for k in _KEYS)))
    both = exact.join(seen, ["grouping", "item", "g"], "full")
    outside = F.sum(F.when(F.col("n").between(F.col("low"), F.col("high")), 0).otherwise(1))
    sketched = F.sum(F.when(F.col("low") < F.col("high"), 1).otherwise(0))
    return both.groupBy("grouping", "item").agg(F.count(F.lit(1)).alias("groups"), (outside <= 0.05 * sketched + 4 * F.sqrt(0.05 * 0.95 * sketched)).alias("covered"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "prompt"))


def p8_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p8_found, with how much of the answer the document holds."""
    return leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "prompt", "answer"), answer="answer")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "split_limits"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each limit: pieces, cuts, the share of cuts at the ends of units, their mean depth, and that of a cut at random in the same windows."""
    pieces = p9_pieces(spark, sf_dir)
    cuts = F.sum((F.col("cut") != "end").cast("bigint"))
    return pieces.groupBy("limit_id").agg(F.count(F.lit(1)).alias("pieces"), cuts.alias("cuts"), (F.count("depth") / cuts).alias("at_units"), F.avg("depth").alias("depth"), F.avg("usual_depth").alias("random_depth"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_lift, p3_pairs, p4_found, p4_counts, p4_coverage, p7_ids, p8_found, p8_answers, p9_pieces, p9_quality)}


_PAIRS = """
            WITH b AS (SELECT DISTINCT customer_id, date, product_id FROM transactions
              WHERE customer_id IS NOT NULL AND date IS NOT NULL AND product_id IS NOT NULL),
            n AS (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id, date FROM b)),
            i AS (SELECT product_id, count(*) AS c FROM b GROUP BY product_id),
            h AS (SELECT b.* FROM b JOIN i USING (product_id), n WHERE c >= {share} * n),
            p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS t FROM h x JOIN h y
              ON x.customer_id = y.customer_id AND x.date = y.date AND x.product_id < y.product_id GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH best AS (SELECT customer_id, product_id, max(final_score) AS s FROM recommendations
              WHERE final_score IS NOT NULL AND NOT isnan(final_score) AND customer_id IS NOT NULL AND product_id IS NOT NULL
              GROUP BY customer_id, product_id)
            SELECT customer_id, product_id, CAST(place AS INTEGER) AS place FROM (
              SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, product_id) AS place FROM best)
            WHERE place <= 10""",
        "p3_found": _PAIRS.format(share=0.006)
        + """
            SELECT p.a AS product_a, p.b AS product_b FROM p JOIN i x ON x.product_id = p.a JOIN i y ON y.product_id = p.b, n
            WHERE t >= 0.006 * n AND t * n >= 3 * x.c * y.c""",
        "p3_lift": _PAIRS.format(share=0.0005)
        + """
            SELECT p.a AS product_a, p.b AS product_b, t AS together, x.c AS baskets_a, y.c AS baskets_b, n AS baskets,
              t * CAST(n AS DOUBLE) / (x.c * CAST(y.c AS DOUBLE)) AS lift
            FROM p JOIN i x ON x.product_id = p.a JOIN i y ON y.product_id = p.b, n WHERE t >= 0.0005 * n""",
        "p3_pairs": _PAIRS.format(share=0)
        + """
            SELECT p.a AS product_a, p.b AS product_b, t AS together, x.c AS baskets_a, y.c AS baskets_b, n AS baskets,
              t * CAST(n AS DOUBLE) / (x.c * CAST(y.c AS DOUBLE)) AS lift
            FROM p JOIN i x ON x.product_id = p.a JOIN i y ON y.product_id = p.b, n""",
        "p4_coverage": " UNION ALL ".join(
            f"SELECT '{'+'.join(s)}' AS grouping, '{i}' AS item, count(*) AS groups, true AS covered FROM (SELECT DISTINCT {', '.join(s)} FROM transactions WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*s, i])})" for s in _SETS for i in _ITEMS
        ),
        "p4_found": """
            SELECT 'date' AS field, strftime(date, '%Y-%m-%d') AS group_key FROM transactions WHERE date IS NOT NULL GROUP BY date
            HAVING count(DISTINCT transaction_id) >= 10 AND 6 * count(DISTINCT customer_id) < count(DISTINCT transaction_id)
            UNION ALL
            SELECT 'product_id', CAST(product_id AS VARCHAR) FROM transactions WHERE product_id IS NOT NULL GROUP BY product_id
            HAVING count(DISTINCT transaction_id) >= 10 AND 6 * count(DISTINCT customer_id) < count(DISTINCT transaction_id)""",
    }
