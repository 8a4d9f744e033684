"""Session defaults shared by the bench, the tests and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "sedimenta", cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster spark-submit's own settings win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEDIMENTA_DRIVER_MEMORY", "8g"))
    )
    if "MASTER" in os.environ or not os.environ.get("SPARK_MASTER_SET"):
        builder = builder.master(os.environ.get("MASTER", f"local[{cores}]"))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
