"""Session helper for local runs, tests and the bench; on a cluster the session comes from spark-submit."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cpus: int | None = None, name: str = "lexiloom", memory: str = "8g") -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
