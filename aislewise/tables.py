"""The tables of one data folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from aislewise.staging import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of the folder, narrowed to `columns` if any are given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def version(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A text that changes with the files of the tables: paths, lengths and times of writing. No file is opened."""
    path, lines = spark._jvm.org.apache.hadoop.fs.Path, []
    for name in names:
        at = path(f"{sf_dir}/{name}.parquet")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while found.hasNext():
            f = found.next()
            lines.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
