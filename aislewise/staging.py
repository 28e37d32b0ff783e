"""Intermediate tables in the folder that all executors share.

Operators that read one intermediate result several times, or that iterate, write it as Parquet here instead of
keeping it in executors: the files outlive a lost executor and cut the lineage. They are removed when the driver ends or, in
a session that goes on, at the end of a `scope`.
"""

from __future__ import annotations

import atexit
import io
import itertools
import shutil
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_counter = itertools.count()
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="aislewise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _written.append((spark, folder))
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/aislewise/{label}-{next(_counter)}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` once, in a folder per value of `by` if given, and return the table read back: same rows and columns, short lineage."""
    path = new_path(df.sparkSession, label)
    writer = df.hint("rebalance", F.col(by)).write.partitionBy(by) if by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per session, so that they need neither its folder nor PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_aislewise_shipped", False):
        return
    context._aislewise_shipped = True
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    try:
        with zipfile.ZipFile(packed, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'code')}/aislewise.zip")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        context.addPyFile(target.toString())
    except Exception as e:  # workers that can import the package by themselves don't need it
        warnings.warn(f"the package could not be sent to the workers: {e}", stacklevel=2)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores, for work that costs far more than moving the rows.

    Only a source of a few files is moved at all; rows and columns stay the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system, whatever scheme it has."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[None]:
    """Remove at its end what was staged inside: run a query and write or fetch its result within one."""
    kept = list(_written)
    try:
        yield
    finally:
        new = [x for x in _written if x not in kept and "/code-" not in x[1] and "/aislewise/" in x[1]]
        _written[:] = [x for x in _written if x not in new]
        _remove(new)


def release() -> None:
    """Remove every staged table. DataFrames that still read one can't be used afterwards."""
    _remove(_written)


def _remove(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        spark, path = paths.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended: what is no local file is left to the cluster's own cleaning
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


atexit.register(release)
