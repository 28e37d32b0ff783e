"""The best N items of every group by one global sort.

Rows are range-partitioned and sorted by group, score and identifier, so a group of any size spreads over as many
partitions as its rows fill. Each partition counts its rows per group; a row's place is its count within the partition
plus the group's counts in the partitions before, and only a partition's first and last group can have any there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.staging import stage


def top_n(df: DataFrame, group: str | Sequence[str], score: str, item: str, n: int) -> DataFrame:
    """(*group, item, score, place): up to n items of each group, place counting from 1 without gaps.

    An item counts once per group, with its highest score; of equal scores the smaller item comes first (-0.0 equals
    0.0). Rows whose score is NULL or NaN, or whose item or any group column is NULL, take no part; a group of such rows
    only, like an empty table, has no result. Ties and repeated rows are thereby settled. Other columns are not read.
    Shuffles: one by (group, item) for the highest score, combined before it moves, one by range for the order. The
    broadcast has at most two rows per partition.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    groups = [group] if isinstance(group, str) else list(group)
    keys = [f"__g{i}" for i in range(len(groups))]
    value = F.col(score)
    ok: Column = value.isNotNull() & F.col(item).isNotNull()
    for g in groups:
        ok &= F.col(g).isNotNull()
    if df.schema[score].dataType.typeName() in ("float", "double"):
        ok &= ~F.isnan(value)
        value = value + F.lit(0.0).cast(df.schema[score].dataType)
    best = (
        df.where(ok)
        .select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(item).alias("__item"), value.alias("__score"))
        .groupBy(*keys, "__item")
        .agg(F.max("__score").alias("__score"))
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.col(k) for k in keys), F.col("__score").desc(), F.col("__item")]
    ranged = best.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    counted = stage(ranged.mapInArrow(_local_places(len(keys), n), f"{fields}, __place int, __edge boolean"), "topn")

    # min(count, n) per partition and group is enough: a group with n rows before has no place left
    by = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counted.where("__edge").groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__held"))
        .withColumn("__before", F.coalesce(F.sum("__held").over(by), F.lit(0)))
        .where("__before > 0").drop("__held")
    )
    place = (F.col("__place") + F.coalesce(F.col("__before"), F.lit(0))).cast("int")
    return (
        counted.join(F.broadcast(before), [*keys, "__part"], "left")
        .withColumn("place", place)
        .where(F.col("place") <= n)
        .select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), F.col("__item").alias(item), F.col("__score").alias(score), "place")
    )


def _local_places(width: int, n: int):  # noqa: ANN202
    """Places within a sorted partition, of which those up to n are kept; edge marks its first and its last group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None  # the partition's first group, the last row's group
        count = 0  # rows of the last row's group so far
        waiting: pa.Table | None = None  # kept rows of the group that may turn out to be the last
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = [table.column(i) for i in range(width)]
            new = np.zeros(len(table), bool)
            for column in key:
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            top = tuple(c[0].as_py() for c in key)
            new[0] = top != held
            if first is None:
                first = top
            starts = np.flatnonzero(new)
            place = np.arange(1, len(table) + 1)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(table)), -1))
            place = np.where(begin < 0, place + count, place - begin)
            last = tuple(c[-1].as_py() for c in key)
            count, held = int(place[-1]), last
            in_first = np.zeros(len(table), bool)
            if top == first:
                in_first[: starts[1] if new[0] and len(starts) > 1 else starts[0] if not new[0] and len(starts) else len(table)] = True
            tail = int(starts[-1]) if len(starts) else 0
            out = table.append_column("__place", pa.array(place, pa.int32())).append_column("__edge", pa.array(in_first))
            if len(starts) and waiting is not None:
                yield from waiting.to_batches()
                waiting = None
            keep = place <= n
            done = out.slice(0, tail).filter(pa.array(keep[:tail]))
            rest = out.slice(tail).filter(pa.array(keep[tail:]))
            if len(done):
                yield from done.combine_chunks().to_batches()
            waiting = rest if waiting is None else pa.concat_tables([waiting, rest])
        if waiting is not None and len(waiting):
            at = waiting.column_names.index("__edge")
            yield from waiting.set_column(at, "__edge", pa.array(np.ones(len(waiting), bool))).combine_chunks().to_batches()

    return run
