"""Vector store operations: unit vectors, top-k cosine search in blocks, block sums over all pairs, centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from aislewise.functions.scalar import unit

#: Vectors of one side that are sent to all tasks: at 256 dimensions 40 MB. Larger sides meet in a grid of blocks.
SENT_VECTORS = 20_000
#: Vectors of either side in a block of the grid (at 256 dimensions 64 MB), and of both in one matrix product.
BLOCK_VECTORS, _ROWS = 32_768, 2048


def normalised(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector as doubles of length 1); vectors of length 0 stay zero, NULL vectors and ids are left out."""
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(id_col, unit(F.col(vector)).alias(vector))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def _met(small: DataFrame, large: DataFrame, work: Callable[[np.ndarray, np.ndarray, Iterable], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` over the vectors of `small` (id, v) and all vectors of `large` (id, v), in as many pieces as need be; `work` gets (ids, matrix) pairs of `large`.

    A small side of up to SENT_VECTORS is broadcast, and the large one stays where it is. Otherwise both are cut into
    blocks by a hash of the id, and each pair of blocks meets in a task: nothing passes through the driver, each side is
    read once, and a task holds one block of either side.
    """
    spark, count = large.sparkSession, small.count()
    if count <= SENT_VECTORS:
        rows = small.orderBy("id").collect()
        if not rows:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(*shared.value, ((b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows))

        return large.select("id", "v").mapInArrow(scan, schema)
    parts = [max(1, math.ceil(1.1 * n / BLOCK_VECTORS)) for n in (count, large.count())]

    def blocks(df: DataFrame, own: str, other: str, of: int, copies: int) -> DataFrame:
        return df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)).groupBy("i", "j")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            found = list(work(a.column("id").to_numpy(), _matrix(a.column("v")), [(b.column("id").to_numpy(), _matrix(b.column("v")))]))
        return pa.Table.from_batches(found) if found else empty

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return blocks(small, "i", "j", *parts).cogroup(blocks(large, "j", "i", parts[1], parts[0])).applyInArrow(cell, schema)


def _nearest(k: int) -> Callable[[np.ndarray, np.ndarray, Iterable], Iterator[pa.RecordBatch]]:
    """The k best of all vectors for each query, of equal scores the smaller ids."""

    def work(query: np.ndarray, q: np.ndarray, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        row, own, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(query), -np.inf)  # what a score must reach to be among the k
        for ids, matrix in pieces:
            rows, found, scores = [row], [own], [best]
            for lo in range(0, len(ids), _ROWS):
                for at in range(0, len(query), _ROWS):
                    score = np.round(q[at : at + _ROWS] @ matrix[lo : lo + _ROWS].T, 12)
                    bar = least[at : at + _ROWS]
                    if score.shape[1] > k:
                        bar = np.maximum(bar, np.partition(score, -k, axis=1)[:, -k])
                    i, j = np.nonzero(score >= bar[:, None])
                    rows.append(at + i)
                    found.append(ids[lo + j])
                    scores.append(score[i, j])
            row, own, best = np.concatenate(rows), np.concatenate(found), np.concatenate(scores)
            order = np.lexsort((own, -best, row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            order = order[place < k]
            row, own, best, place = row[place < k], own[order], best[order], place[place < k]
            full = place == k - 1
            least[row[full]] = best[full]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(own), pa.array(best)], names=["query_id", "id", "score"])

    return work


def top_k_cosine(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int, pad: bool = False) -> DataFrame:
    """(query_id, id, score, place): the k vectors nearest to each query by cosine, of equal scores the smaller id.

    Blocks of queries and vectors are scored by matrix products, each task keeps k per query, and the tasks' candidates
    are merged. With `pad`, places beyond the number of vectors come out with id 0 and score 0. k = 0 gives no rows.
    Queries and vectors have integer ids and one length.
    """
    schema = "query_id bigint, id bigint, score double"
    if k < 1:
        return vectors.sparkSession.createDataFrame([], schema + ", place int")

    def unit_vectors(df: DataFrame) -> DataFrame:
        return normalised(df, id_col, vector).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))

    wanted = unit_vectors(queries)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = _met(wanted, unit_vectors(vectors), _nearest(k), schema).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    if pad:
        spine = wanted.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place"))
        top = spine.join(top, ["query_id", "place"], "left").na.fill(0, ["id", "score"]).select("query_id", "id", "score", "place")
    return top


def all_pairs(left: DataFrame, right: DataFrame, id_col: str, vector: str, at_least: float | None = None) -> DataFrame:
    """(left_id, right_id, score): dot products of all pairs of vectors, block by block; with `at_least` only those that reach it.

    The result has as many rows as there are pairs where nothing bounds it; NULL ids and vectors have none.
    """

    def work(ids: np.ndarray, matrix: np.ndarray, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for other, block in pieces:
            for at in range(0, len(ids), _ROWS):
                for lo in range(0, len(other), _ROWS):
                    score = matrix[at : at + _ROWS] @ block[lo : lo + _ROWS].T
                    i, j = np.nonzero(score >= (-np.inf if at_least is None else at_least))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array(other[lo + j]), pa.array(score[i, j])], names=["left_id", "right_id", "score"])

    return _met(_plain(left, id_col, vector), _plain(right, id_col, vector), work, "left_id bigint, right_id bigint, score double")


def _plain(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    known = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    return known.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def affinity(customers: DataFrame, products: DataFrame, id_col: str, vector: str, above: float) -> DataFrame:
    """(id, total, above, average): per product the sum of its scores over all customers, how many exceed `above`, and the mean.

    Each task adds up its customers' scores block by block, so no pair is written out. NULL vectors and products
    without an id take no part.
    """

    def work(ids: np.ndarray, p: np.ndarray, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total, high, n = np.zeros(len(ids)), np.zeros(len(ids), np.int64), 0
        for _, matrix in pieces:
            for lo in range(0, len(matrix), _ROWS):
                for at in range(0, len(ids), _ROWS):
                    score = matrix[lo : lo + _ROWS] @ p[at : at + _ROWS].T
                    total[at : at + _ROWS] += score.sum(axis=0)
                    high[at : at + _ROWS] += (score > above).sum(axis=0)
            n += len(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(high), pa.array(np.full(len(ids), n))], names=["id", "total", "above", "n"])

    people = customers.where(F.col(vector).isNotNull()).select(F.xxhash64(vector).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = _met(_plain(products, id_col, vector), people, work, "id bigint, total double, above bigint, n bigint").where("n > 0")
    return found.groupBy("id").agg(F.sum("total").alias("total"), F.sum("above").alias("above"), (F.sum("total") / F.sum("n")).alias("average"))


def mean_vectors(vectors: DataFrame, group: str | None, vector: str, at_unit_length: bool = False) -> DataFrame:
    """(group, n, vector): elementwise mean per group (one row of all without a group), in doubles.

    Each batch of rows is added up by group before anything moves, so a hot group sends one sum per batch. NULL vectors are
    left out; a NULL group is one. Vectors have one length; a NULL element counts as NaN.
    """
    key = F.col(group) if group else F.lit(1)
    kind = vectors.schema[group].dataType.simpleString() if group else "int"
    narrow = vectors.where(F.col(vector).isNotNull()).select(key.alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = batch.column(0).dictionary_encode(null_encoding="encode")
                at, groups, matrix = code.indices.to_numpy(), len(code.dictionary), _matrix(batch.column(1))
                sums = np.zeros((groups, matrix.shape[1]))
                np.add.at(sums, at, matrix)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(groups + 1, dtype=np.int32) * matrix.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.bincount(at, minlength=groups)), lists], names=["g", "n", "s"])

    partial = narrow.mapInArrow(add, f"g {kind}, n bigint, s array<double>").select("g", "n", F.posexplode("s").alias("pos", "x"))
    sums = partial.groupBy("g", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("m")))), lambda s: s["m"])
    whole = sums.groupBy("g").agg(F.max("n").alias("n"), mean.alias(vector))
    whole = whole.withColumn(vector, unit(F.col(vector))) if at_unit_length else whole
    return whole.withColumnRenamed("g", group) if group else whole.drop("g")


def demand_ranking(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Products by mean affinity x buyers x dollar margin."""
    joined = features.join(scores.withColumnRenamed("id", "product_id"), "product_id")
    demand = F.col("average") * F.col("buyers")
    return joined.select("product_id", "category", "average", "above", demand.alias("demand"), (demand * F.col("margin") * F.col("price")).alias("score"))
