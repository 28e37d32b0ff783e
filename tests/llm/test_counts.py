"""Top-N, co-occurrence and distinct counts against plain computations."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import cooccurrence as co
from aislewise.llm.distinct import estimates, fill, merge_sketches, partial_sketches, sketch, sparse_groups
from aislewise.llm.topn import top_n


@pytest.mark.parametrize("batch", [7, 10_000])
def test_top_n(spark, batch):
    rng = random.Random(4)
    rows = [(1, rng.randint(1, 400), rng.choice([None, float("nan"), -0.0, 0.0, round(rng.random(), 1)]), "x") for _ in range(900)]
    rows += [(rng.randint(2, 60), rng.randint(1, 9), round(rng.random(), 1), "x") for _ in range(500)] + [(None, 1, 1.0, "x"), (2, None, 1.0, "x"), (500, 3, None, "x")]
    df = spark.createDataFrame(rows, "g int, i int, s double, place string").repartition(4)
    best = {}
    for g, i, s, _ in rows:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), -9))
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    expect = sorted((g, i, place) for g, own in by.items() for place, (_, i) in enumerate(sorted(own)[:10], 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = top_n(df, "g", "s", "i", 10).select("g", "i", "place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == expect
    assert top_n(df.limit(0), "g", "s", "i", 3).count() == 0
    assert top_n(df, ["g", "place"], "s", "i", 1).count() == len(by)


def baskets(seed=5):
    rng = random.Random(seed)
    rows = []
    for b in range(400):
        for _ in range(rng.choice([1, 2, 3, 6])):
            rows.append((b, rng.choice([1, 2, 3, 4] + list(range(5, 60)))))
    for b in (1000, 1001, 1002):
        rows += [(b, i) for i in range(1, 60, 2)]
    return rows


def brute(rows, least):
    by = defaultdict(set)
    for b, i in rows:
        by[b].add(i)
    single, pair = Counter(), Counter()
    for items in by.values():
        single.update(items)
        pair.update(combinations(sorted(items), 2))
    return {(a, b, n, single[a], single[b], len(by)) for (a, b), n in pair.items() if n >= least}


@pytest.mark.parametrize(("one_in", "long", "sent", "least"), [(64, 24, 65_536, 1), (8, 4, 65_536, 2), (8, 4, 0, 2), (1, 2, 65_536, 1), (100_000, 2, 65_536, 1), (8, 4, 65_536, 9), (2, 4, 0, 30)])
def test_cooccurrence(spark, monkeypatch, one_in, long, sent, least):
    monkeypatch.setattr(co, "HEAVY_ONE_IN", one_in)
    monkeypatch.setattr(co, "LONG", long)
    monkeypatch.setattr(co, "SENT_ITEMS", sent)
    monkeypatch.setattr(co, "_BLOCK", 100)
    monkeypatch.setattr(co, "SENT_PAIRS", 0 if least == 2 else 1_000_000)  # all pairs are counted, or the likely ones
    monkeypatch.setattr(co, "MOST_HEAVY", 5 if least == 2 else 4096)  # the rest of the heavy items count as light
    rows = baskets()
    df = spark.createDataFrame([(b, "k", i, 1.0) for b, i in rows] + [(1, "k", None, 0.0), (None, "k", 3, 0.0), (1, None, 3, 0.0), (9999, "k", None, 0.0)] + [(b, "k", i, 2.0) for b, i in rows[:50]], "b int, c string, item int, lift double")
    got = {tuple(r)[:6] for r in co.cooccurrence(df, ["b", "c"], "item", min_baskets=least).collect()}
    assert got == brute(rows, least)
    assert co.cooccurrence(df.limit(0), ["b"], "item", min_baskets=least).count() == 0


def test_registers_are_unbiased():
    rng = np.random.default_rng(1)
    m, inside, ratios = 127, 0, []
    for n in (1, 50, 300, 3000):
        for _ in range(60):
            reg = np.full((1, m), np.inf, np.float32)
            fill(reg, np.zeros(n, np.int64), rng.integers(-(2**63), 2**63 - 1, n))
            ratios.append((m - 1) / reg.sum() / n)
            inside += abs(ratios[-1] - 1) < 1.96 / np.sqrt(m - 2)
    assert abs(np.mean(ratios) - 1) < 3.5 / np.sqrt(m - 2) / np.sqrt(len(ratios))
    assert 0.9 < inside / len(ratios) < 0.99


def test_merging_equals_one_pass():
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 900)
    one, parts = np.full((1, 61), np.inf, np.float32), [np.full((1, 61), np.inf, np.float32) for _ in range(3)]
    fill(one, np.zeros(900, np.int64), h)
    for k, p in enumerate(parts):
        own = h[k::3]
        fill(p, np.zeros(len(own), np.int64), own)
        fill(p, np.zeros(len(own), np.int64), own)  # again: nothing changes
    assert (np.minimum.reduce(parts) == one).all()


def events(spark):
    return spark.sql("SELECT CAST(id % 3 AS INT) AS g, CASE WHEN id % 50 = 0 THEN NULL ELSE id % 4 END AS h, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 2000 END AS x, id DIV 2 AS y, 'z' AS estimate FROM range(6000)")


def test_estimates(spark):
    df = events(spark)
    sets = [["g"], ["h"], ["g", "h"], []]
    got = estimates(sketch(df, sets, ["x", "y"], 251), 1 - 1e-6).collect()
    assert len(got) == 2 * (3 + 4 + 12 + 1)
    for keys in sets:
        name = "+".join(keys)
        where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
        truth = {tuple(r[k] for k in keys): (r["x"], r["y"]) for r in df.where(where).groupBy(*keys).agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()}
        for r in got:
            if r["grouping"] == name:
                n = truth[tuple(r[k] for k in keys)]["xy".index(r["item"])]
                assert r["low"] <= n <= r["high"], (name, r, n)
                assert n > 125 or r["estimate"] == n
    assert estimates(sketch(df.limit(0), sets, ["x"], 61)).count() == 0


def test_partials_may_be_merged_later(spark):
    df = events(spark).cache()
    a, b = (partial_sketches(df.where(w), [["g"]], ["x"], 61).withMetadata("registers", {"m": 61}) for w in ("y < 1000", "y >= 900"))
    both = {(r["g"], tuple(r["registers"]), tuple(sorted(r["hashes"]))) for r in merge_sketches(merge_sketches(a).unionByName(b).withMetadata("registers", {"m": 61})).collect()}
    once = {(r["g"], tuple(r["registers"]), tuple(sorted(r["hashes"]))) for r in sketch(df, [["g"]], ["x"], 61).collect()}
    assert both == once
    with pytest.raises(ValueError, match="prime"):
        partial_sketches(df, [["g"]], ["x"], 100)


def test_sparse_groups(spark):
    rows = [(1, i, i % 20) for i in range(400)] + [(2, i, i) for i in range(400, 800)] + [(3, i, 5) for i in range(800, 809)] + [(4, i, None) for i in range(900, 920)] + [(None, i, 1) for i in range(1000, 1100)] + [(5, None, 1)] * 30
    df = spark.createDataFrame(rows, "k int, t int, c int")
    got = {tuple(r) for r in sparse_groups(df, ["k"], "t", "c", 10, 6).collect()}
    assert got == {("k", "1"), ("k", "4")}


def test_sparse_groups_at_every_stage(spark, monkeypatch):
    """With few registers: groups settled by the first sketch, by the second and by exact counts; the same result as plain sets."""
    from aislewise.llm import distinct

    rng = random.Random(8)
    rows = []
    for k in range(60):
        n = rng.randint(5, 900)
        d = max(1, int(n * rng.choice([0.02, 0.1, 0.16, 0.17, 0.2, 0.9])))
        rows += [(k, f"d{k % 7}", f"{k}-{i}", rng.randrange(d) if rng.random() > 0.05 else None) for i in range(n)]
    rows += rows[:300] + [(None, None, "x", 1), (99, None, None, 2)]
    df = spark.createDataFrame(rows, "k int, g string, t string, c int")
    expect = set()
    for field, at in (("k", 0), ("g", 1)):
        t, c = defaultdict(set), defaultdict(set)
        for r in rows:
            if r[at] is not None:
                t[r[at]] |= {r[2]} - {None}
                c[r[at]] |= {r[3]} - {None}
        expect |= {(field, str(k)) for k in t if len(t[k]) >= 10 and 6 * len(c[k]) < len(t[k])}
    open_ = []
    decide = distinct._decide
    monkeypatch.setattr(distinct, "_decide", lambda *a: open_.append(decide(*a)) or open_[-1])
    got = [tuple(r) for r in sparse_groups(df, ["k", "g"], "t", "c", 10, 6, (151, 601)).collect()]
    assert len(got) == len(set(got)) and set(got) == expect
    first, second = ({tuple(r) for r in o.collect()} for _, o in open_)
    assert 0 < len(second) < len(first) < 67 and all(d.count() for d, _ in open_)
