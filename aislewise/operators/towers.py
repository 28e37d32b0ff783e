"""Inference of small dense encoders over feature columns, and scores of entities against a mean vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters of an encoder that may be broadcast (8 bytes each: 80 MB).
MAX_PARAMETERS = 10_000_000
_ROWS = 8192


def forward(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rectified layers, the last one linear and scaled to length 1 (zero rows stay zero)."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 1e-12, length, 1)


def encode_rows(df: DataFrame, id_col: str, features: Sequence[str], layers: Sequence[tuple[np.ndarray, np.ndarray]], vector: str = "vector") -> DataFrame:
    """(id, vector array<float>): each row's features through the layers; NULL features count as 0. No shuffle."""
    if sum(w.size + b.size for w, b in layers) > MAX_PARAMETERS:
        raise ValueError("the encoder is too large to send along")
    shared = df.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])
    kind = df.schema[id_col].dataType.simpleString()
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = np.column_stack([batch.column(1 + i).to_numpy() for i in range(len(features))])
                y = forward(x, shared.value).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "vector"])

    return df.select(F.col(id_col).alias("id"), *numbers).mapInArrow(run, f"id {kind}, vector array<float>").withColumnsRenamed({"id": id_col, "vector": vector})
