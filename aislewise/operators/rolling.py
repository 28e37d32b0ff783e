"""Totals over trailing days for every entity and day, by block decomposition.

Days are cut into blocks as long as the window. With prefix and suffix sums inside the blocks, the window that ends on a
day is the suffix of the block it begins in plus the prefix of the block it ends in: two additions per window and day,
whatever the window's length, and no subtraction of running totals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTITIES = 512


def trailing_sums(daily: np.ndarray, window: int) -> np.ndarray:
    """For each row and each day, the sum of that day and the window - 1 days before (nothing before the first)."""
    rows, days = daily.shape
    blocks = -(-days // window)
    padded = np.zeros((rows, blocks * window), daily.dtype)
    padded[:, :days] = daily
    cut = padded.reshape(rows, blocks, window)
    prefix = np.cumsum(cut, axis=2).reshape(rows, -1)
    suffix = np.cumsum(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    total = prefix[:, :days].copy()
    day = np.arange(window, days)
    day = day[(day + 1) % window != 0]  # else the window is a whole block
    total[:, day] += suffix[:, day - window + 1]
    return total


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    amount: Column,
    first_day: dt.date,
    last_day: dt.date,
    windows: Sequence[int],
    once: str | None = None,
    above: Mapping[int, int] | None = None,
) -> DataFrame:
    """(entity, day, total_<w>, average_<w> for each window): one row for each entity and each day from first to last.

    An entity is any non-NULL value with a row (of any amount) on a non-NULL day within the range; days without rows are
    there with what the window still holds. `amount` is an integer expression (cents), NULL counts as nothing, and totals
    are exact; an average is the total over the window's length in days, activity or not. With `once`, rows that agree in
    it (and so in entity, day and amount) count once; rows where it is NULL count each. `above` keeps the rows whose
    total of a window is larger than the given one. Days before the first hold nothing. An empty table gives no rows.

    Three hash shuffles, each combined before it moves: by (entity, day, once), by (entity, day), by entity. The last has
    at most one row per day, so an entity with a third of all rows is no larger there than any other.
    """
    days = (last_day - first_day).days + 1
    if days < 1 or any(w < 1 for w in windows):
        raise ValueError("no day in the range, or a window of no day")
    limits = dict(above or {})
    index = F.datediff(F.col(day), F.lit(first_day))
    rows = df.where(F.col(entity).isNotNull() & F.col(day).between(F.lit(first_day), F.lit(last_day)))
    rows = rows.select(F.col(entity).alias("e"), index.alias("d"), amount.cast("bigint").alias("a"), *([F.col(once).alias("o")] if once else []))
    if once:
        loose = rows.where("o IS NULL").groupBy("e", "d").agg(F.sum("a").alias("a"))
        rows = rows.where("o IS NOT NULL").groupBy("e", "d", "o").agg(F.max("a").alias("a")).select("e", "d", "a").unionByName(loose)
    daily = rows.groupBy("e", "d").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    series = daily.groupBy("e").agg(F.collect_list("d").alias("d"), F.collect_list("a").alias("a"))
    kind = df.schema[entity].dataType.simpleString()
    columns = "".join(f", total_{w} bigint, average_{w} double" for w in windows)
    epoch = (first_day - dt.date(1970, 1, 1)).days

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ENTITIES):
                batch = whole.slice(at, _ENTITIES)
                n, lists = batch.num_rows, batch.column(1)
                matrix = np.zeros((n, days), np.int64)
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                matrix[row, lists.flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
                totals = {w: trailing_sums(matrix, w) for w in windows}
                keep = np.ones((n, days), bool)
                for w, least in limits.items():
                    keep &= (totals[w] if w in totals else trailing_sums(matrix, w)) > least
                which, when = np.nonzero(keep)
                out = [batch.column(0).take(pa.array(which)), pa.array((when + epoch).astype(np.int32), pa.int32()).cast(pa.date32())]
                names = ["e", "day"]
                for w in windows:
                    own = totals[w][which, when]
                    out += [pa.array(own), pa.array(own / w)]
                    names += [f"total_{w}", f"average_{w}"]
                yield from pa.Table.from_arrays(out, names=names).to_batches(65_536)

    return series.mapInArrow(run, f"e {kind}, day date{columns}").withColumnRenamed("e", entity)
