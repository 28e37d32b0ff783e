"""Per-key results that don't suffer from a few keys holding most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.staging import stage

#: Equal parts of an interval in one round.
BINS = 1024
#: Intervals up to this number (a few MB) are broadcast in a round; more are joined with salt.
SENT_INTERVALS = 50_000
_INF = float("inf")


def exact_ranks(df: DataFrame, key: str, value: str, ranks: Column) -> DataFrame:
    """(key, n, rank, value, equal): the value of each wanted rank among a key's values, from 1 in rising order.

    `ranks` is an array-of-bigint expression over `key` and `n` (the key's rows); ranks outside 1..n are left out.
    `equal` is the number of the key's rows with that value. Rows with a NULL key or a NULL or NaN value take no part, so
    an empty table or key has no result; repeated rows count as often as they occur. `value` is a number, infinite ones
    included, or a date.

    No key's rows are gathered. Each round counts, per key, the rows in BINS equal parts of the interval that still holds
    wanted ranks (counts, least and largest value merge map-side), and keeps the parts that hold one, shrunk to their
    own least and largest value; a part with one value is resolved. The ends of an interval fall into its first and last
    part, so every round leaves fewer rows. A round reads the rows once and moves a histogram per task.
    """
    kind, is_date = df.schema[value].dataType, df.schema[value].dataType.typeName() == "date"
    floating = kind.typeName() in ("double", "float")
    number = F.unix_date(F.col(value)) if is_date else F.col(value)
    ok = F.col(key).isNotNull() & F.col(value).isNotNull()
    if floating:
        ok &= ~F.isnan(value)
        number = number.cast("double") + F.lit(0.0)
    rows = df.where(ok).select(F.col(key).alias("k"), number.alias("v"))
    # infinite values are no ends of an interval: they are counted apart, below and above all others
    finite = F.abs("v") != _INF if floating else F.lit(True)
    lowest, highest = (F.count(F.when(F.col("v") == x, 1)) if floating else F.lit(0).cast("bigint") for x in (-_INF, _INF))
    span = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"), lowest.alias("neg"), highest.alias("pos")
    )
    keys = stage(span.withColumn("want", F.filter(ranks, lambda r: (r >= 1) & (r <= F.col("n")))), "keys")
    each = keys.select("k", "n", "lo", "hi", "neg", "pos", F.explode("want").alias("rank"))
    inside = (F.col("rank") > F.col("neg")) & (F.col("rank") <= F.col("n") - F.col("pos"))
    found = []
    if floating:
        rows = rows.where(finite)
        low = F.col("rank") <= F.col("neg")
        found.append(each.where(~inside).select("k", "n", "rank", F.when(low, -_INF).otherwise(_INF).alias("v"), F.when(low, F.col("neg")).otherwise(F.col("pos")).alias("equal")))

    # a wanted rank and the interval that holds it: least and largest value inside, rows below, rows in it
    open_ = each.where(inside).select("k", "n", "rank", "lo", "hi", F.col("neg").alias("below"), (F.col("n") - F.col("neg") - F.col("pos")).alias("held"))
    before = None
    while True:
        found.append(open_.where("lo = hi").select("k", "n", "rank", F.col("lo").alias("v"), F.col("held").alias("equal")))
        active = open_.where("lo < hi")
        left, held = active.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("held").cast("decimal(38,0)")), F.lit(0))).first()
        if not left:
            break
        if before is not None and held >= before:
            raise RuntimeError("a round of exact_ranks left as many rows as the one before")
        before = held
        counts = _within(rows, active, keys, left).groupBy("k", F.col("lo").alias("of"), _part(floating).alias("bin")).agg(F.sum("w").alias("c"), F.min("v").alias("bl"), F.max("v").alias("bh"))
        up_to = Window.partitionBy("k", "of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = counts.withColumn("cum", F.sum("c").over(up_to))
        wanted = active.select("k", F.col("lo").alias("of"), "n", "rank", "below")
        open_ = stage(
            whole.join(wanted, ["k", "of"])
            .where((F.col("rank") > F.col("below") + F.col("cum") - F.col("c")) & (F.col("rank") <= F.col("below") + F.col("cum")))
            .select("k", "n", "rank", F.col("bl").alias("lo"), F.col("bh").alias("hi"), (F.col("below") + F.col("cum") - F.col("c")).alias("below"), F.col("c").alias("held")),
            "ranks",
        )
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    back = F.date_from_unix_date(F.col("v").cast("int")) if is_date else F.col("v").cast(kind)
    return result.select(F.col("k").alias(key), "n", F.col("rank"), back.alias(value), "equal")


def _part(floating: bool) -> Column:
    """Which of BINS equal parts of [lo, hi] holds v: never falling in v, 0 for lo and the last for hi."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if floating:  # of huge numbers a quarter, since their difference may be infinite
        size = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 1e300, 0.25).otherwise(1.0)
        share = (v * size - lo * size) / (hi * size - lo * size)
    else:  # exact differences unless the interval is wider than the type
        exact = F.try_subtract(v, lo).cast("double") / F.try_subtract(hi, lo).cast("double")
        wide = (v.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))
        share = F.when(F.try_subtract(hi, lo).isNull(), wide).otherwise(exact)
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def _within(rows: DataFrame, active: DataFrame, keys: DataFrame, intervals: int) -> DataFrame:
    """(k, v, w, lo, hi): rows within the open intervals of their key, with a weight.

    Up to SENT_INTERVALS intervals are broadcast. Of more, each key has as many salts as it has even shares of all rows:
    equal values are added up before they move, the others of a key are spread by value.
    """
    spans = active.select("k", "lo", "hi").distinct()
    near = F.col("v").between(F.col("lo"), F.col("hi"))
    if intervals <= SENT_INTERVALS:
        return rows.withColumn("w", F.lit(1).cast("bigint")).join(F.broadcast(spans), "k").where(near)
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (keys.agg(F.sum("n")).first()[0] or 0) // parts)
    hot = F.broadcast(keys.where(F.col("n") > share).select("k", F.ceil(F.col("n") / share).cast("int").alias("salts")))  # fewer than `parts` keys
    one = F.coalesce("salts", F.lit(1))
    weighted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w")).join(hot, "k", "left").withColumn("salt", F.pmod(F.xxhash64("v"), one).cast("int")).drop("salts")
    salted = spans.join(hot, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    return weighted.join(salted, ["k", "salt"]).where(near)


def key_quantiles(df: DataFrame, key: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """(key, n, one column p<percent> per probability): exact discrete quantiles, the least value that at least that share of the key's values doesn't exceed."""
    wanted = F.array(*(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9))).cast("bigint") for p in probabilities))
    ranked = exact_ranks(df, key, value, F.array_distinct(wanted))
    columns = [
        F.max(F.when(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9))), F.col(value))).alias(f"p{round(p * 100):02d}")
        for p in probabilities
    ]
    return ranked.groupBy(key, "n").agg(*columns)


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(field, key_id bigint, rows): the values of each of the integer columns `keys` that hold at least `share` of all rows.

    A value that fills so many successive ranks of its column covers a multiple of that number, so the values at those
    ranks, found by exact_ranks with the column's name as the key, are all that can qualify. NULL is no value but its
    rows count among all rows.
    """
    total = df.count()
    step = max(1, math.ceil(total * share - 1e-9))
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("bigint").alias("key_id")) for k in keys))).alias("e")
    long = df.select(*keys).select(entries).select("e.*")
    ranks = F.when(F.col("n") >= step, F.sequence(F.lit(step).cast("bigint"), F.col("n"), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return exact_ranks(long, "field", "key_id", ranks).where(F.col("equal") >= step).select("field", "key_id", F.col("equal").alias("rows")).distinct()


def key_totals(df: DataFrame, keys: Sequence[str], once: str, amount: Column) -> DataFrame:
    """(field, key_id bigint, rows, items, total): per value of each of the columns `keys`, its rows, distinct `once` and the sum of `amount` over these.

    Rows that agree in `once` agree in `amount`. Both steps combine before they shuffle, and the first spreads a key's
    rows by `once`. NULL keys are left out; NULL `once` counts in rows only; NULL amounts count as nothing.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("bigint").alias("key_id")) for k in keys))).alias("e")
    narrow = df.select(F.col(once).alias("__once"), amount.alias("__amount"), entries).select("e.*", "__once", "__amount").where("key_id IS NOT NULL")
    lines = narrow.groupBy("field", "key_id", "__once").agg(F.count(F.lit(1)).alias("__rows"), F.max("__amount").alias("__amount"))
    counted = F.col("__once").isNotNull()
    return lines.groupBy("field", "key_id").agg(
        F.sum("__rows").alias("rows"), F.count("__once").alias("items"), F.coalesce(F.sum(F.when(counted, F.col("__amount"))), F.lit(0)).alias("total")
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right on `key` (inner or left), where some keys of `left` hold very many rows.

    A key with more rows than an even share of a partition is hot; there are at most 4 per shuffle partition, so their
    list may be broadcast. The rows of a hot key are spread over as many salts as it has such shares, and `right`'s rows
    of that key are repeated once per salt. Other keys have one salt. NULL keys match nothing: they leave an inner join
    and stay, unmatched, in a left one. The salt is a hash of the row and of the input partition it is in, so that equal rows spread, too,
    and a task that runs again gives a row the same salt. Columns of the same name other than the key come out twice, as in any join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    spark = left.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where("__k IS NOT NULL")
    total = left.count()
    share = max(1, -(-total // parts))
    hot = stage(counts.where(F.col("__n") > share).select("__k", F.ceil(F.col("__n") / share).cast("int").alias("__salts")), "hot")
    content = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = left.withColumn("__row", F.xxhash64(*content, F.spark_partition_id()))
    salted_left = spread.join(F.broadcast(hot), spread[key] == hot["__k"], "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.col("__row"), F.col("__salts")).cast("int"))
    )
    other = right.join(F.broadcast(hot.withColumnRenamed("__k", "__k2")), right[key] == F.col("__k2"), "left").withColumn(
        "__salt2", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    )
    a = salted_left.drop("__k", "__salts", "__row").alias("a")
    b = other.drop("__k2", "__salts").withColumnRenamed(key, "__key2").alias("b")
    joined = a.join(b, (F.col(f"a.{key}") == F.col("b.__key2")) & (F.col("a.__salt") == F.col("b.__salt2")), how)
    return joined.drop("__salt", "__salt2", "__key2")
