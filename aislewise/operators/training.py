"""Training of two dense encoders whose dot product scores pairs: synchronous steps, gradients summed by Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.towers import MAX_PARAMETERS
from aislewise.staging import stage

Layers = list[tuple[np.ndarray, np.ndarray]]
#: The step size, the decay of Adam's two moments, the largest norm of a gradient, and the margin at which
#: an example counts one and a half times.
RATE, DECAY, MOST_NORM, FULL_MARGIN = 1e-3, (0.9, 0.999), 1.0, 0.75
_SLICE = 16_384


@dataclass
class Trained:
    """The layers of both encoders, and (epoch, loss, rate) after each epoch."""

    left: Layers
    right: Layers
    epochs: list[tuple[int, float, float]]


def run_forward(x: np.ndarray, layers: Layers) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Unit vectors of the rows, with what a step backwards needs: the inputs of each layer and the lengths."""
    inputs = []
    for i, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / length, inputs, length


def run_backward(grad: np.ndarray, unit: np.ndarray, inputs: list[np.ndarray], length: np.ndarray, layers: Layers) -> Layers:
    """Gradients of each layer, from that of the unit vectors."""
    grad = (grad - unit * (grad * unit).sum(axis=1, keepdims=True)) / length
    found = []
    for (w, _), x in zip(reversed(layers), reversed(inputs), strict=True):
        found.append((x.T @ grad, grad.sum(axis=0)))
        grad = (grad @ w.T) * (x > 0)  # the input of a later layer is rectified; that of the first isn't used
    return found[::-1]


def batch_gradient(a: np.ndarray, b: np.ndarray, negatives: np.ndarray, label: np.ndarray, weight: np.ndarray, margin: np.ndarray, left: Layers, right: Layers) -> tuple[float, Layers, Layers]:
    """Summed loss and gradients: cross-entropy of the pair, plus the mean of that of its negatives, by weight and margin.

    `negatives` is examples x negatives x inputs; there may be none.
    """
    weight = weight * (0.5 + np.clip(margin, 0, FULL_MARGIN) / FULL_MARGIN)
    n, k = negatives.shape[:2]
    u, u_in, u_len = run_forward(a, left)
    v, v_in, v_len = run_forward(np.concatenate([b, negatives.reshape(n * k, -1)]) if k else b, right)
    pos, neg = v[:n], v[n:].reshape(n, k, v.shape[1])
    s, t = (u * pos).sum(axis=1), np.einsum("nd,nkd->nk", u, neg)

    def loss_of(x: np.ndarray, y: np.ndarray | float) -> np.ndarray:
        return np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))

    each = loss_of(s, label) + (loss_of(t, 0.0).mean(axis=1) if k else 0.0)
    ds = weight * (1 / (1 + np.exp(-s)) - label)
    dt = weight[:, None] / (1 + np.exp(-t)) / max(1, k)
    du = ds[:, None] * pos + np.einsum("nk,nkd->nd", dt, neg)
    dv = np.concatenate([ds[:, None] * u, (dt[:, :, None] * u[:, None, :]).reshape(n * k, -1)]) if k else ds[:, None] * u
    return float((weight * each).sum()), run_backward(du, u, u_in, u_len, left), run_backward(dv, v, v_in, v_len, right)


def flat(*sides: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for side in sides for layer in side for x in layer])


def shaped(values: np.ndarray, like: Layers) -> tuple[Layers, np.ndarray]:
    out, at = [], 0
    for w, b in like:
        own = [values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]]
        at += w.size + b.size
        out.append((own[0], own[1]))
    return out, values[at:]


def gradient(examples: DataFrame, left: Layers, right: Layers) -> tuple[float, int, np.ndarray]:
    """Summed loss, examples and summed flat gradient. Each task sends one gradient, in slices that other tasks add up: one copy reaches the driver."""
    shared = examples.sparkSession.sparkContext.broadcast((left, right))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        total, count, sums = 0.0, 0, np.zeros(flat(*mine).size)
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b, negatives = (batch.column(i).flatten() for i in range(3))
                wide = len(b) // n
                values = negatives.flatten().to_numpy(zero_copy_only=False)
                numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)]
                loss, *grads = batch_gradient(a.to_numpy().reshape(n, -1), b.to_numpy().reshape(n, -1), values.reshape(n, -1, wide), *numbers, *mine)
                total, count, sums = total + loss, count + n, sums + flat(*grads)
        if count:
            sums = np.append(sums, [total, count])
            parts = [sums[at : at + _SLICE] for at in range(0, len(sums), _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["slice", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = x.values.to_numpy()
                sums[at] = sums[at] + own if at in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["slice", "x"])

    schema = "slice int, x array<double>"
    rows = examples.select("a", "b", "negatives", "label", "weight", "margin").mapInArrow(work, schema).repartition("slice").mapInArrow(add, schema).collect()
    if not rows:
        return 0.0, 0, np.zeros(flat(left, right).size)
    whole = np.concatenate([np.array(r["x"]) for r in sorted(rows, key=lambda r: r["slice"])])
    return float(whole[-2]), int(whole[-1]), whole[:-2]


def train(examples: DataFrame, key: Sequence[str], left: Layers, right: Layers, epochs: int, batches: int, folder: str | None = None, rate: float = RATE) -> Trained:
    """Adam over `batches` steps an epoch, with a rate that falls by a cosine, gradients cut to a norm of 1, and the layers written after each epoch.

    `examples` has a and b (arrays of inputs), negatives (an array of arrays like b, of one length, maybe empty), label,
    weight and margin, without NULL. They are written once, by batch: a hash of the columns `key` and nothing else says
    which batch an example is in. A step reads its batch and sends the layers (bounded: MAX_PARAMETERS) to the tasks. An
    empty table leaves the layers as they are, with losses of NaN. `folder` gets one Parquet folder per epoch.
    """
    if flat(left, right).size > MAX_PARAMETERS:
        raise ValueError("the encoders are too large to send along")
    spark = examples.sparkSession
    cut = F.pmod(F.xxhash64(*key), F.lit(batches)).cast("int")
    kinds = {"a": "array<double>", "b": "array<double>", "negatives": "array<array<double>>", "label": "double", "weight": "double", "margin": "double"}
    held = stage(examples.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), cut.alias("batch")), "examples", by="batch")
    values, first, second = flat(left, right), 0.0, 0.0
    steps, step, history = epochs * batches, 0, []
    for epoch in range(epochs):
        losses, seen = 0.0, 0
        for batch in range(batches):
            l, rest = shaped(values, left)
            r, _ = shaped(rest, right)
            loss, n, grad = gradient(held.where(F.col("batch") == batch), l, r)
            now = rate * (1 + math.cos(math.pi * step / steps)) / 2
            step += 1
            if not n:
                continue
            losses, seen = losses + loss, seen + n
            grad = grad / n
            grad = grad * min(1.0, MOST_NORM / (np.linalg.norm(grad) + 1e-6))
            first, second = DECAY[0] * first + (1 - DECAY[0]) * grad, DECAY[1] * second + (1 - DECAY[1]) * grad**2
            values = values - now * (first / (1 - DECAY[0] ** step)) / (np.sqrt(second / (1 - DECAY[1] ** step)) + 1e-8)
        history.append((epoch, losses / seen if seen else math.nan, now))
        if folder:
            parts = [(i, values[at : at + _SLICE].tolist()) for i, at in enumerate(range(0, len(values), _SLICE))]
            spark.createDataFrame(parts, "slice int, x array<double>").write.mode("overwrite").parquet(f"{folder}/epoch-{epoch}")
    l, rest = shaped(values, left)
    return Trained(l, shaped(rest, right)[0], history)
