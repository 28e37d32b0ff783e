"""Store rows from web pages that carry structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.scalar import digits, title, zip5

#: The attribute whose JSON lists a page's stores, that JSON's fields, and the fields and types of stores in
#: the public vocabulary for structured data.
ATTRIBUTE = "slcp-props"
_LISTED = (
    "storeResult array<struct<storeNumber: string, phone: string, address: struct<firstLine: string, secondLine: string>, mapPin: struct<lat: string, lng: string>,"
    " identifiers: array<string>, indicators: array<string>, weeklyAdData: struct<address: struct<city: string, state: string, zip: string, street: string>,"
    " hours: struct<departments: array<struct<name: string, regHours: array<struct<weekday: string, startTime: string, endTime: string>>>>>>>>"
)
_DATA = (
    "array<struct<`@type`: string, branchCode: string, identifier: string, name: string, telephone: string,"
    " address: struct<streetAddress: string, addressLocality: string, addressRegion: string, postalCode: string>, geo: struct<latitude: string, longitude: string>>>"
)
TYPES = ("Pharmacy", "Store", "LocalBusiness", "DrugStore", "MedicalBusiness")
ENTITIES = {"&quot;": '"', "&#34;": '"', "&#x22;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_COLUMNS = ("store", "name", "address", "city", "state", "zip_code", "latitude", "longitude", "phone", "kind", "hours_mon_fri", "hours_sat", "hours_sun")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _phone(text: Column) -> Column:
    """(AAA) BBB-CCCC of ten digits, or of eleven that begin with 1; other texts as they are."""
    bare = F.regexp_replace(digits(text), "^1([0-9]{10})$", "$1")
    return F.when(F.length(bare) == 10, F.regexp_replace(bare, "^(...)(...)(....)$", "($1) $2-$3")).otherwise(text)


def _listed(pages: DataFrame, key: str, html: str, attribute: str) -> DataFrame:
    """Stores from the JSON in an attribute, quoted either way; entities are undone."""
    quoted = (F.nullif(F.regexp_extract(html, rf"(?s){attribute}={q}(.*?){q}", 1), F.lit("")) for q in ('"', "'"))
    text = F.coalesce(*quoted)
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    s = pages.select(F.col(key).alias("page"), F.explode(F.from_json(text, _LISTED)["storeResult"]).alias("s")).where(F.trim("s.storeNumber") != "")
    lines = F.transform(F.split(F.trim("s.address.secondLine"), ","), lambda x: F.trim(x))
    three, words = F.size(lines) >= 3, F.split(F.trim(F.get(lines, 1)), r"\s+")
    ad = F.col("s.weeklyAdData.address")

    def first(*texts: Column) -> Column:
        return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))

    two = F.size(lines) >= 2
    street = first(F.col("s.address.firstLine"), ad["street"])
    flags = F.lower(F.array_join(F.concat(F.coalesce("s.identifiers", F.array().cast("array<string>")), F.coalesce("s.indicators", F.array().cast("array<string>"))), " "))
    store = F.filter("s.weeklyAdData.hours.departments", lambda d: F.lower(d["name"]).isin("retail", "store"))
    days = F.flatten(F.transform(store, lambda d: d["regHours"]))

    def hours(day: str) -> Column:
        own = F.filter(days, lambda h: (F.upper(h["weekday"]) == day) & (h["startTime"] != "") & (h["endTime"] != ""))
        return F.coalesce(F.try_element_at(F.transform(own, lambda h: F.concat(h["startTime"], F.lit(" - "), h["endTime"])), F.lit(-1)), F.lit(""))

    return s.select(
        "page", F.trim("s.storeNumber").alias("store"), F.lit(None).cast("string").alias("name"), F.when(street == F.upper(street), title(street)).otherwise(street).alias("address"),
        title(first(F.when(two, F.get(lines, 0)), ad["city"])).alias("city"), F.upper(first(F.when(two, F.when(three, F.get(lines, 1)).otherwise(F.get(words, 0))), ad["state"])).alias("state"),
        F.substring(first(F.when(three, F.get(lines, 2)).when(two, F.get(words, 1)), ad["zip"]), 1, 5).alias("zip_code"), _number(F.col("s.mapPin.lat")).alias("latitude"), _number(F.col("s.mapPin.lng")).alias("longitude"),
        _phone(F.trim("s.phone")).alias("phone"), F.when(flags.contains("minuteclinic"), "clinic").when(flags.contains("target"), "in another store").otherwise("pharmacy").alias("kind"),
        hours("MON").alias("hours_mon_fri"), hours("SAT").alias("hours_sat"), hours("SUN").alias("hours_sun"),
    )


def _described(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Stores from all JSON-LD blocks of a page, each a store or a list of stores; other things are left out."""
    position = F.split(F.regexp_extract(html, r'(?i)name="geo\.position"\s+content="([^"]*)"', 1), ";")
    blocks = pages.select(F.col(key).alias("page"), position.alias("p"), F.explode(F.regexp_extract_all(html, F.lit(_BLOCK))).alias("b"))
    d = blocks.select("page", "p", F.explode(F.from_json("b", _DATA)).alias("d")).where(F.col("d.`@type`").isin(*TYPES) | F.col("d.`@type`").isNull())
    empty = F.lit("")
    return d.select(
        "page", F.coalesce("d.branchCode", "d.identifier").alias("store"), F.trim("d.name").alias("name"), title(F.trim("d.address.streetAddress")).alias("address"), title(F.trim("d.address.addressLocality")).alias("city"),
        F.upper(F.trim("d.address.addressRegion")).alias("state"), zip5(F.col("d.address.postalCode")).alias("zip_code"),
        F.coalesce(_number(F.col("d.geo.latitude")), _number(F.try_element_at("p", F.lit(1)))).alias("latitude"), F.coalesce(_number(F.col("d.geo.longitude")), _number(F.try_element_at("p", F.lit(2)))).alias("longitude"),
        F.col("d.telephone").alias("phone"), F.lit("pharmacy").alias("kind"), empty.alias("hours_mon_fri"), empty.alias("hours_sat"), empty.alias("hours_sun"),
    )


def store_pages(pages: DataFrame, key: str, html: str, attribute: str = ATTRIBUTE) -> DataFrame:
    """(key, store, name, address, city, state, zip_code, latitude, longitude, phone, kind, hours_mon_fri, hours_sat, hours_sun): all stores of each page.

    Stores come from the JSON of an attribute and, for pages where that gives none, from the JSON-LD blocks; there,
    coordinates fall back to the page's geo.position tag, and an item without a type counts as a store. Stores without an
    address or coordinates (or with both 0), unreadable data and NULL pages have no row. `key` is unique. In the JVM.
    """

    def whole(df: DataFrame) -> DataFrame:
        there = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ((F.col("latitude") != 0) | (F.col("longitude") != 0))
        return df.where(there & (F.col("address") != ""))

    listed = whole(_listed(pages, key, html, attribute))
    rest = pages.join(listed.select(F.col("page").alias(key)).distinct(), key, "left_anti")
    return listed.unionByName(whole(_described(rest, key, html))).select(F.col("page").alias(key), *_COLUMNS)
