"""The feature store: partial aggregates, incremental updates, periods."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from aislewise.operators.feature_store import Events, FeatureStore, clean_number
from aislewise.plans import large_tables
from aislewise.staging import new_path

OF = Events("who", "day", "id", ("kind",), "cents")
SCHEMA = "who int, day date, id int, kind string, cents int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(w, dt.date.fromisoformat(d) if d else None, i, k, c, "extra") for w, d, i, k, c in rows], SCHEMA)


BASE = [
    (1, "2024-01-05", 1, "a", 100), (1, "2024-01-05", 1, "a", 100), (1, "2024-01-20", 2, "b", 50), (1, "2024-02-03", 3, "a", None),
    (2, "2024-03-10", 4, None, 7), (2, None, 5, "a", 9), (None, "2024-01-01", 6, "a", 1), (2, "2024-03-11", None, "a", 1), (2, "2024-03-11", None, "a", 1),
]


def as_set(df):
    return {(r["entity"], r["kind"], r["n"], r["total"], str(r["first"]), str(r["last"])) for r in df.collect()}


def test_merge_and_update(spark):
    store = FeatureStore(spark, new_path(spark, "store"), OF)
    first = frame(spark, BASE)
    assert store.update(first) == ["2024-01-01", "2024-02-01", "2024-03-01", "none"]
    assert as_set(store.merged()) == {
        (1, "a", 2, 100, "2024-01-05", "2024-02-03"), (1, "b", 1, 50, "2024-01-20", "2024-01-20"), (2, None, 1, 7, "2024-03-10", "2024-03-10"), (2, "a", 3, 11, "2024-03-11", "2024-03-11"),
    }
    assert store.update(first) == []
    more = frame(spark, [*BASE, (1, "2024-02-04", 8, "a", 5)])
    folders = store.manifest()
    assert store.update(more) == ["2024-02-01"]
    assert {b for b, e in store.manifest().items() if folders[b] != e} == {"2024-02-01"}
    assert (1, "a", 3, 105, "2024-01-05", "2024-02-04") in as_set(store.merged())
    assert store.update(first.where("day < '2024-02-01'")) == []  # buckets without events are dropped
    assert as_set(store.merged()) == {(1, "a", 1, 100, "2024-01-05", "2024-01-05"), (1, "b", 1, 50, "2024-01-20", "2024-01-20")}


def test_period(spark):
    store = FeatureStore(spark, new_path(spark, "store"), OF)
    rows = frame(spark, BASE)
    store.update(rows)
    got = as_set(store.merged(rows, "2024-01-10", "2024-03-10"))
    assert got == {(1, "b", 1, 50, "2024-01-20", "2024-01-20"), (1, "a", 1, 0, "2024-02-03", "2024-02-03"), (2, None, 1, 7, "2024-03-10", "2024-03-10")}
    assert as_set(store.merged(None, "2024-02-01", "2024-02-29")) == {(1, "a", 1, 0, "2024-02-03", "2024-02-03")}
    with pytest.raises(ValueError, match="give the events"):
        store.merged(None, "2024-01-10", "2024-03-10")


def test_empty_and_reserved(spark):
    store = FeatureStore(spark, new_path(spark, "store"), OF)
    assert store.update(frame(spark, BASE).limit(0)) == []
    assert store.merged(frame(spark, BASE).limit(0)).count() == 0
    with pytest.raises(ValueError, match="name of a column"):
        FeatureStore(spark, "x", Events("who", "day", "id", ("n",)))


def test_entities_absent_and_days(spark):
    """A bucket whose events all lack an entity is none; buckets of a day keep the day."""
    store = FeatureStore(spark, new_path(spark, "store"), OF)
    rows = frame(spark, [*BASE, (None, "2024-07-01", 70, "a", 1), (None, None, 71, "a", 1)])
    assert store.update(rows) == ["2024-01-01", "2024-02-01", "2024-03-01", "none"]
    plain = FeatureStore(spark, new_path(spark, "store"), OF)
    plain.update(frame(spark, BASE))
    assert as_set(store.merged()) == as_set(plain.merged())
    assert store.update(frame(spark, [(None, "2024-07-01", 70, "a", 1)])) == [] and store.merged(rows).count() == 0
    for unit, first in {"day": "2024-01-05", "week": "2024-01-01", "quarter": "2024-01-01", "year": "2024-01-01"}.items():
        by = FeatureStore(spark, new_path(spark, "store"), dataclasses.replace(OF, bucket=unit))
        assert by.update(frame(spark, BASE))[0] == first
        assert as_set(by.merged()) == as_set(plain.merged())
        assert as_set(by.merged(frame(spark, BASE), "2024-01-10", "2024-03-10")) == as_set(plain.merged(frame(spark, BASE), "2024-01-10", "2024-03-10"))
    with pytest.raises(ValueError, match="must be one of"):
        dataclasses.replace(OF, bucket="hour")


def test_three_updates_and_versions(spark):
    """A store that persists: each update rewrites the buckets that changed, and a known version reads nothing."""
    path = new_path(spark, "store")
    states = [frame(spark, BASE), frame(spark, [*BASE, (3, "2024-02-09", 20, "c", 4)]), frame(spark, [*BASE[1:], (3, "2024-02-09", 20, "c", 4), (3, "2024-05-09", 21, "c", 4)])]
    changed = [["2024-01-01", "2024-02-01", "2024-03-01", "none"], ["2024-02-01"], ["2024-01-01", "2024-05-01"]]
    for i, (rows, expect) in enumerate(zip(states, changed, strict=True)):
        store = FeatureStore(spark, path, OF)  # opened anew, as in another session
        before = store.manifest()
        assert store.update(rows, f"v{i}") == expect and store.version() == f"v{i}"
        after = store.manifest()
        assert sorted(b for b in after if before.get(b) != after[b]) == expect
        fresh = FeatureStore(spark, new_path(spark, "store"), OF)
        fresh.update(rows)
        assert as_set(store.merged()) == as_set(fresh.merged())
    assert store.update(rows.select(F.raise_error(F.lit("read")).alias("who"), "day", "id", "kind", "cents"), "v2") == []


def test_persistent_queries(spark, tmp_path):
    """With a folder for stores, a second run of a query rewrites no bucket and gives the same rows."""
    folder = "/root/testdata/sf0.001"
    plain = large_tables.p5_found(spark, folder).collect()
    spark.conf.set("spark.aislewise.features", str(tmp_path))
    try:
        first = large_tables.p5_found(spark, folder).collect()
        files = sorted(tmp_path.rglob("*.parquet"))
        second = large_tables.p5_found(spark, folder).collect()
    finally:
        spark.conf.unset("spark.aislewise.features")
    assert sorted(plain) == sorted(first) == sorted(second) and files == sorted(tmp_path.rglob("*.parquet")) and len(files) > 10


def test_types_from_the_data(spark):
    rows = spark.createDataFrame([("a b",), ("a-b",), ("Zeta",), (None,), ("!",)], "kind string")
    assert large_tables._types(rows, "kind") == [{"!": "blank", "Zeta": "zeta", "a b": "a_b", "a-b": "a_b_"}]


def test_clean_number(spark):
    cases = {
        "EC0000000042": 42, " ec0000000042": 42, "EC-0000000042": 42, "ＥＣ0000000042\t": 42, "0000000042": 42, "EC 000 000 0042": 42, "EC42": 42, "ＥＣ００42": 42,
        "EC": None, "": None, "unknown": None, "N/A": None, "XX42": None, "EC9000000001": 9000000001, "4 2 EC": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", clean_number("s").alias("n")).collect()} == {**cases, None: None}
