"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def spark_session(app: str = "veritally", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster, pass the session that the cluster hands out instead; nothing
    in the package depends on the values set here.
    """
    cores = str(cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
