"""Sessions with the settings that the library's results rely on, and the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, shuffle partitions by the cores. On a cluster, use its own session with the time zone in UTC."""
    n = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("HELIOSCOPE_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("helioscope")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
