"""Session factory used by the tests, the benchmark and interactive work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "feuillet", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for: UTC, AQE with skew handling."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).master(f"local[{cpus}]").config(map=settings).getOrCreate()
