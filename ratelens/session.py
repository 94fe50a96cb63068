"""Session helper: one place for the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", app: str = "ratelens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
