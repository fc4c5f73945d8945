"""Spark session of tests and bench (local mode)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def make_session(cores: str | int = 8, memory: str = "12g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("jobweave")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("JOBWEAVE_MEMORY", memory))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
