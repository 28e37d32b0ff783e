"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "aislewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; `conf` entries override (underscores stand for dots).

    On a cluster the master, the shuffle partitions and `spark.checkpoint.dir` come from spark-submit;
    nothing here pins them. A local master gets one shuffle partition per core.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            inside = master[6:-1] if master.startswith("local[") else "1"
            cores = os.cpu_count() if inside == "*" else inside
            builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
