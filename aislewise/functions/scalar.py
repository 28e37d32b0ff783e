"""Column functions: guarded ratios, buckets, text and identifier formats, vector arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL where whole is 0 or either is NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def margin(price: Column, cost: Column) -> Column:
    return (price - cost) / F.nullif(price, F.lit(0.0))


def money_sum(column: str) -> Column:
    """Exact sum of a column in whole cents, whatever the order of rows; NULL over no value."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def share_sum(column: str) -> Column:
    """Exact sum of fractions with up to four decimals."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def bucket(value: Column, cuts: Sequence[float]) -> Column:
    """0 below the first cut, 1 below the second, and so on; a value on a cut belongs above it."""
    column = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        column = F.when(value < cuts[i], i).otherwise(column)
    return column


def lookup(key: Column, values: Mapping[str, object], default: object) -> Column:
    """A constant per key, else the default."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def draw(*keys: Column | str | int) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of the MD5 of the keys."""
    text = F.concat_ws("|", *(F.lit(k).cast("string") if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def title(text: Column) -> Column:
    """Each run of letters with a capital first and small letters behind; other characters stay."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)")), lambda run: F.initcap(F.lower(run))), "")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def sigmoid(x: Column, bound: float = 500.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.greatest(std, F.lit(1e-8))


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def card_number(customer: Column) -> Column:
    return F.format_string("EC%010d", customer)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone(text: Column) -> Column:
    """(AAA) BBB-CCCC from the last ten digits; NULL with fewer."""
    bare = digits(text)
    ten = F.right(bare, F.lit(10))
    formatted = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return F.when(F.length(bare) >= 10, formatted)


def zip5(text: Column) -> Column:
    """The first five digits of a zip code, with leading zeros restored."""
    return F.lpad(F.substring(F.trim(F.split(F.trim(text), "-")[0]), 1, 5), 5, "0")


def hash_digits(text: Column, count: int) -> Column:
    """Decimal digits of the MD5 of a text, as many as asked for, zeros behind."""
    return F.rpad(F.substring(F.regexp_replace(F.md5(text), "[^0-9]", ""), 1, count), count, "0")


def check_digit(code: Column) -> Column:
    """Check digit of an 11-digit product code: odd places count three times."""
    places = [F.substring(code, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(11)]
    total = places[0]
    for p in places[1:]:
        total = total + p
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def upc(text: Column) -> Column:
    code = F.concat(F.lit("0"), hash_digits(text, 10))
    return F.concat(code, check_digit(code).cast("string"))


def ndc(text: Column) -> Column:
    d = hash_digits(text, 11)
    return F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 4), F.substring(d, 10, 2))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vector: Column, least: float = 1e-10) -> Column:
    """The vector at length 1, as doubles; one shorter than `least` stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > least, x.cast("double") / length).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
