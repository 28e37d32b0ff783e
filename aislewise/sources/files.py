"""File sources and sinks: Parquet, CSV (plain or compressed), JSON, arrays, binary vector files, catalog tables."""

from __future__ import annotations

import io
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats in order of preference, by the file endings that mark them.
FORMATS = (("parquet", (".parquet",)), ("csv", (".csv.zst", ".csv.gz", ".csv")))
#: The header of a binary vector file (magic, version, count, dimensions, 6 reserved bytes).
VECTOR_MAGIC, VECTOR_VERSION, VECTOR_HEADER = b"VCDB", 1, "<4sHII6x"


def read_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files of a path, a folder or a glob; a schema narrows and types the columns without a footer scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV files, compressed or not, by an explicit schema; rows that don't fit it (a cut last line) are dropped."""
    return spark.read.schema(schema).option("header", header).option("mode", "DROPMALFORMED").csv(path if isinstance(path, str) else list(path))


def detect_format(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(format, glob) of the files in a folder, Parquet before CSV, compressed CSV before plain; an error without any."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    for kind, endings in FORMATS:
        for ending in endings:
            if any(n.endswith(ending) for n in names):
                return kind, f"{folder}/*{ending}"
    raise FileNotFoundError(f"no Parquet or CSV file in {folder}")


def read_detected(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    kind, glob = detect_format(spark, folder)
    return read_parquet(spark, glob, schema) if kind == "parquet" else read_csv(spark, glob, schema)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: Sequence[str] = (), mode: str = "error") -> str:
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, compression: str = "none") -> str:
    df.write.option("header", True).option("compression", compression).csv(path)
    return path


def ensure_parquet(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table at `path`, built only if it isn't wholly there; and whether it was built."""
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path), False
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


def convert_csv(spark: SparkSession, paths: Sequence[str], target: str, schema: T.StructType | str) -> list[str]:
    """Convert CSV files one by one to zstd Parquet below `target`, skipping those that are done; the folders."""
    out = []
    for path in paths:
        name = os.path.basename(path.rstrip("/")).split(".")[0]
        ensure_parquet(spark, f"{target}/{name}", lambda p=path: read_csv(spark, p, schema))
        out.append(f"{target}/{name}")
    return out


def json_lines(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_vector_file(path: str, ids: np.ndarray, vectors: np.ndarray) -> None:
    """A binary vector file of 32-bit ids and vectors on a local or mounted path."""
    with open(path, "wb") as f:
        f.write(struct.pack(VECTOR_HEADER, VECTOR_MAGIC, VECTOR_VERSION, len(ids), vectors.shape[1]))
        f.write(np.ascontiguousarray(ids, "<u4").tobytes())
        f.write(np.ascontiguousarray(vectors, "<f4").tobytes())


def write_vector_files(df: DataFrame, folder: str, key: str, vector: str) -> list[str]:
    """Write (id, vector) of all rows as binary vector files, one per partition that has rows, from the executors; the paths.

    `folder` is a local or mounted path that all executors can open. Each attempt of a task writes a file of its own, of
    which only those that count are returned. NULL, ids that don't fit 32 bits and vectors of several lengths in a
    partition are errors.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids, width = f"{folder}/{uuid.uuid4().hex}.vdb", [], None
        with tempfile.TemporaryFile(dir=folder) as vectors:
            for batch in batches:
                own, lists = batch.columns
                if not batch.num_rows:
                    continue
                if own.null_count or lists.null_count or (flat := lists.flatten()).null_count:
                    raise ValueError("a vector file holds no NULL")
                own = own.to_numpy()
                widths = np.unique(lists.value_lengths().to_numpy())
                width = int(widths[0]) if width is None else width
                if own.min() < 0 or own.max() >= 2**32:
                    raise ValueError("a vector file holds 32-bit ids")
                if len(widths) > 1 or widths[0] != width or not 0 < width < 2**16:
                    raise ValueError("a vector file holds vectors of one length")
                ids.append(own.astype("<u4"))
                vectors.write(np.ascontiguousarray(flat.to_numpy(), "<f4").tobytes())
            if not ids:
                return
            count = sum(map(len, ids))
            vectors.seek(0)
            with open(path, "wb") as f:
                f.write(struct.pack(VECTOR_HEADER, VECTOR_MAGIC, VECTOR_VERSION, count, width))
                for own in ids:
                    f.write(own.tobytes())
                shutil.copyfileobj(vectors, f)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    return [r[0] for r in rows.mapInArrow(run, "path string").collect()]


def read_vector_file(spark: SparkSession, path: str | Sequence[str], rows_per_task: int = 100_000) -> DataFrame:
    """(id bigint, vector array<float>) of binary vector files that all executors can open; tasks read ranges of them.

    A file with another magic or version, without dimensions or cut short is an error.
    """
    size, parts = struct.calcsize(VECTOR_HEADER), []
    for one in [path] if isinstance(path, str) else path:
        with open(one, "rb") as f:
            head = f.read(size)
        if len(head) < size:
            raise ValueError("not a vector file: too short")
        magic, version, count, width = struct.unpack(VECTOR_HEADER, head)
        if magic != VECTOR_MAGIC or version != VECTOR_VERSION or width == 0:
            raise ValueError("not a vector file of this version")
        if os.path.getsize(one) < size + 4 * count * (1 + width):
            raise ValueError("the vector file is cut short")
        parts += [(one, count, width, start) for start in range(0, count, rows_per_task)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                one, count, width, start = parts[at]
                n = min(rows_per_task, count - start)
                ids = np.fromfile(one, "<u4", n, offset=size + 4 * start)
                flat = np.fromfile(one, "<f4", n * width, offset=size + 4 * count + 4 * start * width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), lists], names=["id", "vector"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, "id bigint, vector array<float>")


def write_npz_files(df: DataFrame, folder: str, key: str, vector: str) -> list[str]:
    """Write (id, vector) of all rows as NPZ files with the arrays `ids` and `vectors`, one per partition that has rows; the paths.

    `folder` is a local or mounted path that all executors can open. NULL and vectors of several lengths in a partition
    are errors; numbers keep their type (float or double).
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            own, lists = batch.columns
            if own.null_count or lists.null_count or (flat := lists.flatten()).null_count or len(np.unique(lists.value_lengths().to_numpy())) > 1:
                raise ValueError("an array file holds vectors of one length and no NULL")
            if batch.num_rows:
                ids.append(own.to_numpy())
                vectors.append(flat.to_numpy().reshape(batch.num_rows, -1))
        if ids:
            path = f"{folder}/{uuid.uuid4().hex}.npz"
            np.savez(path, ids=np.concatenate(ids), vectors=np.concatenate(vectors))
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return [r[0] for r in df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector")).mapInArrow(run, "path string").collect()]


def read_npz_files(spark: SparkSession, path: str | Sequence[str], kind: str = "float") -> DataFrame:
    """(id bigint, vector array of `kind`) of NPZ files with `ids` and `vectors`, from any file system; a task reads whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with np.load(io.BytesIO(content.as_py())) as held:
                    ids, vectors = held["ids"], np.ascontiguousarray(held["vectors"], {"float": "<f4", "double": "<f8"}[kind])
                for at in range(0, len(ids), 10_000):
                    part = vectors[at : at + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000].astype(np.int64)), lists], names=["id", "vector"])

    return spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("content").mapInArrow(run, f"id bigint, vector array<{kind}>")


def first_by_id(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order`, combined before it moves."""
    rest = [c for c in df.columns if c != key]
    chosen = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(key).agg(chosen).select(key, *(F.col("__row")[c].alias(c) for c in rest))
