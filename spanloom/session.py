"""A local session with the settings the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    out = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out
