"""Training: gradients against differences, steps against one process, losses that fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.operators import training
from aislewise.plans import registry


def layers(rng, *sizes):
    return [(rng.normal(0, 0.6, (a, b)), rng.normal(0, 0.1, b)) for a, b in zip(sizes, sizes[1:])]


def rows_of(rng, n, negatives=2):
    return [
        (i, rng.normal(size=3).tolist(), rng.normal(size=4).tolist(), rng.normal(size=(negatives, 4)).tolist(), float(rng.integers(0, 2)), float(rng.choice([0.5, 1.0])), float(rng.normal(0.3, 0.4))) for i in range(n)
    ]


def arrays(rows, negatives=2):
    a, b, neg, *rest = (np.array([r[i] for r in rows], float) for i in range(1, 7))
    return a, b, neg.reshape(len(rows), negatives, 4), *rest


SCHEMA = "id int, a array<double>, b array<double>, negatives array<array<double>>, label double, weight double, margin double"


@pytest.mark.parametrize("negatives", [0, 2])
def test_gradient_against_differences(negatives):
    rng = np.random.default_rng(1)
    left, right = layers(rng, 3, 5, 4), layers(rng, 4, 6, 4)
    data = arrays(rows_of(rng, 7, negatives), negatives)
    _, *grads = training.batch_gradient(*data, left, right)
    values, got = training.flat(left, right), training.flat(*grads)
    for i in rng.permutation(len(values))[:40]:
        ends = []
        for step in (1e-6, -1e-6):
            moved = values.copy()
            moved[i] += step
            l, rest = training.shaped(moved, left)
            ends.append(training.batch_gradient(*data, l, training.shaped(rest, right)[0])[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - got[i]) < 1e-5


def test_steps_against_one_process(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "_SLICE", 10)
    rng = np.random.default_rng(2)
    left, right, rows = layers(rng, 3, 5, 4), layers(rng, 4, 6, 4), rows_of(np.random.default_rng(3), 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = training.train(df, ["id"], left, right, 3, 2, str(tmp_path), 0.05)
    batch = {r["id"]: r["b"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("b")).collect()}
    values, m, v, step = training.flat(left, right), 0.0, 0.0, 0
    for epoch in range(3):
        losses = 0.0
        for k in range(2):
            l, rest = training.shaped(values, left)
            own = [r for r in rows if batch[r[0]] == k]
            loss, *grads = training.batch_gradient(*arrays(own), l, training.shaped(rest, right)[0])
            g = training.flat(*grads) / len(own)
            g *= min(1, 1 / (np.linalg.norm(g) + 1e-6))
            rate = 0.05 * (1 + np.cos(np.pi * step / 6)) / 2
            step += 1
            m, v, losses = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, losses + loss
            values = values - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        assert model.epochs[epoch][1] == pytest.approx(losses / 60)
    assert np.allclose(training.flat(model.left, model.right), values)
    saved = spark.read.parquet(str(tmp_path / "epoch-2")).orderBy("slice").collect()
    assert np.allclose(np.concatenate([r["x"] for r in saved]), values) and len(saved) > 3
    empty = training.train(df.limit(0), ["id"], left, right, 1, 2)
    assert np.isnan(empty.epochs[0][1]) and np.allclose(training.flat(empty.left, empty.right), training.flat(left, right))


def test_training_query(spark):
    rows = registry.queries()["M5"](spark, "/root/testdata/sf0.001").orderBy("epoch").collect()
    assert len(rows) == 4 and rows[-1]["loss"] < 0.98 * rows[0]["loss"] and rows[-1]["rate"] < rows[0]["rate"]
