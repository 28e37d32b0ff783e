"""Operators of the core against plain computations and known values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.functions import scalar
from aislewise.operators import elasticity, features, quality, ranking, series, vectors, warehouse
from aislewise.sources import files
from aislewise.staging import new_path, shared_folder, stage
from aislewise.streaming.windows import first_deliveries, run_available, sessions, windowed_totals


def test_co_purchase(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "_LONG", 5)
    monkeypatch.setattr(warehouse, "_STRIPE", 3)
    monkeypatch.setattr(warehouse, "_CELLS", 60)
    rng = random.Random(1)
    rows = [(c, "2024-01-0%d" % d, rng.randint(1, 30)) for c in range(12) for d in (1, 2) for _ in range(rng.choice([1, 2, 4, 15]))]
    rows += [(None, "2024-01-01", 1), (1, None, 2), (1, "2024-01-01", None)]
    df = spark.createDataFrame(rows, "customer_id int, date string, product_id int").withColumn("date", F.col("date").cast("date"))
    expect = Counter()
    for c, d, p in rows:
        for c2, d2, p2 in rows:
            if None not in (c, d, p, p2) and (c, d) == (c2, d2) and p < p2:
                expect[p, p2] += 1
    assert {(r[0], r[1]): r[2] for r in warehouse.co_purchase(df).collect()} == expect
    assert warehouse.co_purchase(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 8))
    v[7], v[8] = 0, v[9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (None, v[0].tolist())], "id int, v array<float>")
    n = np.linalg.norm(v.astype(np.float32).astype(float), axis=1)
    unit = v.astype(np.float32).astype(float) / np.where(n > 1e-10, n, 1)[:, None]
    for sent in (20_000, 7):
        monkeypatch.setattr(vectors, "SENT_VECTORS", sent)
        monkeypatch.setattr(vectors, "BLOCK_VECTORS", 17)
        monkeypatch.setattr(vectors, "_ROWS", 5)
        got = {}
        for r in vectors.top_k_cosine(df, df, "id", "v", 4).collect():
            got.setdefault(r["query_id"], {})[r["place"]] = r["id"]
        for q in range(50):
            score = np.round(unit @ unit[q], 12)
            order = sorted(range(50), key=lambda i: (-score[i], i))[:4]
            assert [got[q][p] for p in (1, 2, 3, 4)] == order
    assert vectors.top_k_cosine(df, df, "id", "v", 0).count() == 0
    assert vectors.top_k_cosine(df.limit(0), df, "id", "v", 3).count() == 0
    padded = vectors.top_k_cosine(df.where("id = 1"), df.where("id < 2"), "id", "v", 3, pad=True).orderBy("place").collect()
    assert [(r["id"], round(r["score"], 6)) for r in padded][0] == (1, 1.0) and padded[2]["id"] == 0
    total = {r["id"]: r for r in vectors.affinity(df, df.where("id < 5"), "id", "v", 0.3).collect()}
    every = np.vstack([v, v[:1]]).astype(np.float32).astype(float)
    assert abs(total[3]["total"] - (every @ v[3].astype(np.float32)).sum()) < 1e-4


def test_grid_of_blocks(spark, monkeypatch):
    """Both sides large: the same results, and nothing is collected while it is planned or run."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 6)))] + [(None, [1.0] * 6), (500, None)], "id int, v array<double>")
    small = df.where("id % 4 = 0")
    runs = [
        lambda: vectors.affinity(df, small, "id", "v", 0.3).select("id", F.round("total", 9), "above", F.round("average", 9)),
        lambda: vectors.all_pairs(df, small, "id", "v", 0.5).withColumn("score", F.round("score", 9)),
        lambda: vectors.all_pairs(df, small, "id", "v").withColumn("score", F.round("score", 9)),
        lambda: vectors.top_k_cosine(small, df, "id", "v", 3),
    ]
    expect = [sorted(map(tuple, f().collect())) for f in runs]
    assert len(expect[2]) == 90 * 23 and len(expect[3]) == 69
    monkeypatch.setattr(vectors, "SENT_VECTORS", 5)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 16)
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", None)
        m.setattr(type(df), "toPandas", None)
        frames = [f() for f in runs]
    assert [sorted(map(tuple, f.collect())) for f in frames] == expect
    monkeypatch.setattr(vectors, "SENT_VECTORS", 20_000)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 32_768)
    many = spark.range(100_000).select("id", F.array_repeat(F.col("id").cast("double"), 4).alias("v"))
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", None)
        plan = vectors.top_k_cosine(many, many, "id", "v", 10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastExchange" not in plan


def test_mean_vectors(spark):
    rows = [(i % 3 if i % 7 else None, [float(i), i * 0.5]) for i in range(40)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v array<float>")
    got = {r["g"]: (r["n"], r["v"]) for r in vectors.mean_vectors(df, "g", "v").collect()}
    for g in (0, 1, 2, None):
        own = np.array([v for k, v in rows if k == g and v])
        assert got[g][0] == len(own) and np.allclose(got[g][1], own.mean(axis=0))
    whole = vectors.mean_vectors(df, None, "v", True).collect()[0]
    assert whole["n"] == 40 and abs(np.linalg.norm(whole["v"]) - 1) < 1e-12
    assert vectors.mean_vectors(df.limit(0), "g", "v").count() == 0 == vectors.mean_vectors(df.limit(0), None, "v").count()


def test_greedy_ranking(spark):
    rng = random.Random(3)
    rows = [(c, p, round(rng.random(), 1), rng.choice("abc"), rng.random()) for c in range(6) for p in range(70)] + [(1, 99, float("nan"), "a", 0.1), (1, 98, None, "a", 0.1)]
    df = spark.createDataFrame(rows, "customer_id int, product_id int, score double, category string, margin double")
    recent = spark.createDataFrame([(c, p) for c in range(6) for p in range(0, 70, 9)], "customer_id int, product_id int")
    clipped = spark.createDataFrame([(c, p) for c in range(6) for p in range(0, 70, 7)], "customer_id int, product_id int")
    got = {(r["customer_id"], r["place"]): r["product_id"] for r in ranking.constrained_top(df, recent, clipped).collect()}
    for c in range(6):
        own = []
        for cc, p, s, k, m in rows:
            if cc == c and s is not None and s == s:
                own.append((-(s * (1 + m * 0.3) * (0.5 if p % 9 == 0 else 1.0) * (1.15 if p % 7 == 0 else 1.0)), p, k))
        used, out = Counter(), []
        for _, p, k in sorted(own)[:50]:
            if used[k] < 3 and len(out) < 10:
                used[k] += 1
                out.append(p)
        assert [got[c, i + 1] for i in range(len(out))] == out and (c, len(out) + 1) not in got


def test_t_tail_and_slopes(spark):
    p = elasticity.incomplete_beta(np.array([2.5, 0.5, 5.0]), np.array([0.5, 0.5, 0.5]), np.array([5 / (5 + 4.0), 0.5, 10 / (10 + 0.01)]))
    assert np.allclose(p, [0.1019395, 0.5, 0.9223], atol=1e-4)
    points = spark.createDataFrame([("a", 0.1, 1.0, 3), ("a", 0.2, 1.7, 5), ("a", 0.3, 2.1, 2), ("a", 0.5, 4.0, 9), ("b", 0.1, 1.0, 1), ("b", 0.2, 3.0, 1), ("c", 0.1, 1.0, 4)], "k string, x double, y double, w int")
    got = {r["k"]: r for r in elasticity.weighted_slopes(points, "k", "x", "y", "w").collect()}
    x, y, w = np.array([0.1, 0.2, 0.3, 0.5]), np.array([1.0, 1.7, 2.1, 4.0]), np.sqrt([3, 5, 2, 9])
    beta = np.linalg.lstsq(np.c_[np.ones(4), x] * w[:, None], y * w, rcond=None)[0][1]
    assert abs(got["a"]["beta"] - beta) < 1e-9 and 0 < got["a"]["p_value"] < 0.05
    assert abs(got["b"]["beta"] - 20) < 1e-9 and got["b"]["se"] is None and got["b"]["p_value"] is None and "c" not in got


def test_quantiles_of_large_columns(spark):
    df = spark.createDataFrame([(float(i * i % 97),) for i in range(1500)] + [(None,)], "v double")
    row = features.large_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.999}).collect()[0]
    plain = df.selectExpr("percentile(v, 0.1D)", "percentile(v, 0.5D)", "percentile(v, 0.999D)").collect()[0]
    assert [round(x, 9) for x in (row["a"], row["b"], row["c"])] == [round(x, 9) for x in plain]


def test_series(spark):
    df = spark.createDataFrame([("a", e, e not in (2, 3)) for e in range(9)] + [("b", e, True) for e in range(3)], "who string, e int, hit boolean")
    assert [tuple(r) for r in series.first_streak(df, "who", "e", "hit", 4).collect()] == [("a", 7)]
    cv = spark.createDataFrame([(e, 0.9 if e < 3 else 0.01) for e in range(8)], "e int, cv double")
    assert series.converged_at(cv, "e", "cv", 4, 0.05).collect()[0][0] == 7
    assert series.converged_at(cv, "e", "cv", 6, 0.05).collect()[0][0] is None
    filled = series.filled_running_total(spark.createDataFrame([(2, 5), (2, 1), (4, 2)], "e int, n bigint"), "e", "n", 1, 5).orderBy("e").collect()
    assert [(r["n"], r["running"]) for r in filled] == [(0, 0), (6, 6), (0, 6), (2, 8), (0, 8)]


def test_verdicts_and_formats(spark):
    cases = [(5.0, "PASS"), (10.9, "PASS"), (17.5, "WARN"), (30.0, "FAIL"), (None, None), (-0.9, "PASS")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v double")
    assert [r[0] for r in df.select(quality.verdict(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()] == [w for _, w in cases]
    one = spark.createDataFrame([("036000291452", "555-010-1838x", "1234-5678")], "u string, p string, z string")
    row = one.select(scalar.check_digit(F.substring("u", 1, 11)), scalar.phone(F.col("p")), scalar.zip5(F.col("z"))).collect()[0]
    assert tuple(row) == (2, "(555) 010-1838", "01234")


def test_files(spark):
    path = new_path(spark, "files")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    files.write_parquet(df, f"{path}/p")
    assert files.detect_format(spark, f"{path}/p")[0] == "parquet"
    with pytest.raises(FileNotFoundError):
        files.detect_format(spark, f"{path}/nothing")
    assert stage(df.limit(0), "empty").count() == 0
    assert shared_folder(spark) == shared_folder(spark)


def test_vector_files(spark, tmp_path):
    good = tmp_path / "v"
    files.write_vector_file(str(good), np.arange(10), np.ones((10, 3)))
    assert files.read_vector_file(spark, str(good), 4).count() == 10
    data = good.read_bytes()
    for bad in (b"XXXX" + data[4:], data[:-1], data[:6], data[:4] + b"\x09\x00" + data[6:]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError, match="vector file"):
            files.read_vector_file(spark, str(tmp_path / "bad"))


def test_streams(spark):
    path = new_path(spark, "stream")
    rows = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, id % 2 AS kind, 1.5D AS value, id % 3 AS who FROM range(400) UNION ALL SELECT 3, TIMESTAMP_NTZ '2024-01-01 03:00:00', 1, 1.5D, 0")
    files.write_parquet(rows, f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    out = run_available(windowed_totals(stream, "ts", "1 day", "0 seconds", "kind", "value"), f"{path}/out", f"{path}/c")
    batch = windowed_totals(rows, "ts", "1 day", "0 seconds", "kind", "value")
    got = {tuple(r) for r in out.collect()}
    assert got and got <= {tuple(r) for r in batch.collect()}
    assert run_available(first_deliveries(stream, "event_id", "ts", "30 days"), f"{path}/out2", f"{path}/c2").count() == 400
    assert sessions(rows, "who", "ts", "4 hours", "1 day").count() == 3


def test_encoders(spark):
    from aislewise.operators import towers

    layers = [(np.array([[1.0, -1.0], [0.5, 2.0]]), np.array([0.0, 0.1])), (np.eye(2), np.zeros(2))]
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, -3.0), (3, -1.0, 0.0)], "id int, a double, b double")
    got = {r["id"]: list(r["vector"]) for r in towers.encode_rows(df, "id", ["a", "b"], layers).collect()}
    x = np.maximum(np.array([[2.0, 1.0], [0, -3.0], [-1.0, 0]]) @ layers[0][0] + layers[0][1], 0)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    expect = x / np.where(length > 0, length, 1)
    assert np.allclose([got[1], got[2], got[3]], expect, atol=1e-6)


def test_replications(spark):
    from aislewise.operators import replications

    offers = spark.createDataFrame([(c, s) for c in range(2000) for s in (1, 2)], "customer_id int, slot int")
    one = replications.responses(offers, 2, 3, 7, F.lit(0.3), F.lit(0.5))
    got = sorted(map(tuple, one.collect()))
    assert len(got) == 6 and len({r[2] for r in got}) > 1
    assert all(abs(r[2] / 2000 - 0.3) < 0.05 and abs(r[5] - 0.5) < 0.06 and r[3] == 2 * r[2] for r in got)
    assert sorted(map(tuple, replications.responses(offers.repartition(7), 2, 3, 7, F.lit(0.3), F.lit(0.5)).collect())) == got


def test_pages(spark):
    from aislewise.sources.pages import store_pages

    good = '<script type="application/ld+json">{"name": " A ", "telephone": "1", "address": {"streetAddress": "1 OAK st", "addressLocality": "x", "addressRegion": "ny", "postalCode": "123-4"}, "geo": {"latitude": "1.5", "longitude": "2"}}</script>'
    rows = [(1, good), (2, good.replace('"geo"', '"no"')), (3, '<meta name="geo.position" content="3;4">' + good.replace('"geo"', '"no"')), (4, good.replace("{", "", 1)), (5, None), (6, ""), (7, good.replace("streetAddress", "s"))]
    got = {r["id"]: r for r in store_pages(spark.createDataFrame(rows, "id int, html string"), "id", "html").collect()}
    assert set(got) == {1, 3} and (got[1]["address"], got[1]["zip_code"], got[1]["state"], got[3]["latitude"]) == ("1 Oak St", "00123", "NY", 3.0)


def test_pages_with_several_stores(spark):
    """Lists in an attribute, quoted either way and with entities; several blocks and lists of data; other types; hours."""
    import html
    import json

    from aislewise.sources.pages import store_pages

    def store(number, **more):
        return {"storeNumber": number, "address": {"firstLine": "12 MAIN ST", "secondLine": "o'fallon, mo, 63366-1"}, "mapPin": {"lat": 1.5, "lng": -2}, "phone": "1-636-555-0100", **more}

    days = [{"weekday": d, "startTime": "8", "endTime": "9"} for d in ("Mon", "SAT")]
    ad = {"address": {"city": "x", "state": "ny", "zip": "10001", "street": "5 Elm"}, "hours": {"departments": [{"name": "Pharmacy", "regHours": [{"weekday": "MON", "startTime": "1", "endTime": "2"}]}, {"name": "Retail", "regHours": days}]}}
    listed = json.dumps({"storeResult": [store("1"), store("2", address={"firstLine": "", "secondLine": "rome, ny 13440"}, weeklyAdData=ad, indicators=["MinuteClinic"]), store(""), store("3", mapPin={"lat": 0, "lng": 0}), store("4", address={})]})
    item = {"@type": "Store", "branchCode": "7", "name": "A & B", "address": {"streetAddress": "1 oak st"}, "geo": {"latitude": "3", "longitude": "4"}}
    block = '<script type="application/ld+json">{}</script>'.format
    pages = {
        1: f'<x slcp-props="{html.escape(listed)}"></x>' + block(json.dumps(item)), 2: f"<x slcp-props='{listed.replace(chr(39), '&#39;')}'></x>",
        3: block(json.dumps([item, {**item, "branchCode": "8", "@type": "Pharmacy"}, {**item, "@type": "Person"}])) + block("{broken") + block(json.dumps({**item, "branchCode": None, "identifier": "9"})),
        4: '<x slcp-props="{broken"></x>' + block(json.dumps(item)), 5: '<x slcp-props=""></x>',
    }
    got = {}
    for r in store_pages(spark.createDataFrame(list(pages.items()), "id int, html string"), "id", "html").collect():
        got.setdefault(r["id"], {})[r["store"]] = r
    assert {k: set(v) for k, v in got.items()} == {1: {"1", "2"}, 2: {"1", "2"}, 3: {"7", "8", "9"}, 4: {"7"}}
    a, b = got[1]["1"], got[1]["2"]
    assert (a["address"], a["city"], a["state"], a["zip_code"], a["phone"], a["kind"], a["hours_sat"]) == ("12 Main St", "O'Fallon", "MO", "63366", "(636) 555-0100", "pharmacy", "")
    assert (b["address"], b["city"], b["state"], b["zip_code"], b["kind"], b["hours_mon_fri"], b["hours_sun"]) == ("5 Elm", "Rome", "NY", "13440", "clinic", "8 - 9", "")
    assert got[3]["9"]["name"] == "A & B" and got[2]["1"]["address"] == "12 Main St"


def test_array_files(spark, tmp_path):
    rows = [(i, [float(i), i / 3]) for i in range(500)]
    for kind, exact in (("float", np.float32), ("double", np.float64)):
        df = spark.createDataFrame(rows, f"i int, v array<{kind}>")
        paths = files.write_npz_files(df.repartition(3), str(tmp_path / kind), "i", "v")
        assert len(paths) == 3 and set(np.load(paths[0])) == {"ids", "vectors"}
        assert {r["id"]: r["vector"] for r in files.read_npz_files(spark, paths, kind).collect()} == {i: exact(v).tolist() for i, v in rows}
    with pytest.raises(Exception, match="an array file holds"):
        files.write_npz_files(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i int, v array<float>").coalesce(1), str(tmp_path / "bad"), "i", "v")


def test_small_functions(spark):
    from aislewise.functions import scalar

    texts = {"oak HILL road": "Oak Hill Road", "24TH o'neil-ST": "24Th O'Neil-St", "": "", None: None, "é à": "É À"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", scalar.title(F.col("t")).alias("x")).collect()} == texts
    drawn = [r[0] for r in spark.range(4000).select(scalar.draw(1, "id")).collect()]
    assert 0 <= min(drawn) and max(drawn) < 1 and abs(sum(drawn) / 4000 - 0.5) < 0.02
    cases = [(100.0, 100.0, "PASS"), (119.0, 100.0, "PASS"), (70.0, 100.0, "WARN"), (150.0, 100.0, "FAIL"), (1.0, 0.0, None), (None, 1.0, None)]
    got = spark.createDataFrame(cases, "v double, t double, w string").select(quality.compared(F.col("v"), F.col("t")), "w").collect()
    assert all(a == b for a, b in got)
    runs = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 14.0), (2, 16.0), (3, 30.0), (3, None)], "week int, x double")
    assert series.first_and_last(runs, "week", ["x"], 0.1).collect()[0].asDict() == {"metric": "x", "first_mean": 15.0, "last_mean": 30.0, "last_std": 0.0, "steady_at": 2, "variation": 0.0, "change": 1.0}


def test_vector_files_of_partitions(spark, tmp_path):
    rows = [(i, [float(i), i / 3]) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    paths = files.write_vector_files(df.repartition(5), str(tmp_path / "many"), "i", "v")
    assert len(paths) == 5
    got = {r["id"]: r["vector"] for r in files.read_vector_file(spark, paths, 30).collect()}
    assert got == {i: np.float32(v).tolist() for i, v in rows}
    assert files.read_vector_file(spark, files.write_vector_files(df.limit(0), str(tmp_path / "none"), "i", "v")).count() == 0
    for bad in ([(1, None)], [(None, [1.0])], [(-1, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [None])]):
        with pytest.raises(Exception, match="a vector file holds"):
            files.write_vector_files(spark.createDataFrame(bad, "i int, v array<float>").coalesce(1), str(tmp_path / "bad"), "i", "v")


def test_every_vector_is_written_and_read(spark):
    from aislewise.plans import registry

    folder = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    assert len(ids) > 200 and {r[0] for r in registry.queries()["S18"](spark, folder).select("id").distinct().collect()} == ids


def test_rounding_of_every_total(spark):
    """All rows come out, ties rounded away from zero, against exact decimals."""
    from decimal import ROUND_HALF_UP, Decimal

    from aislewise.plans import registry

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/transactions.parquet").select("transaction_id", "total").collect()]
    exact = [(i, None if x is None else Decimal(repr(x)) * 3) for i, x in rows]
    ties = [x for _, x in exact if x is not None and x * 100 % 10 in (5, -5)]
    assert min(ties) < 0 < max(ties) and None in dict(exact).values()
    expect = [(i, None if x is None else float(x.quantize(Decimal("0.1"), ROUND_HALF_UP))) for i, x in exact]
    assert sorted(map(str, map(tuple, registry.queries()["F2"](spark, folder).collect()))) == sorted(map(str, expect))


def test_scope(spark):
    from pathlib import Path

    from aislewise.staging import scope

    before = stage(spark.range(3), "kept")
    with scope():
        path = stage(spark.range(5), "inside").inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert Path(path).exists()
    assert not Path(path).exists() and before.count() == 3
