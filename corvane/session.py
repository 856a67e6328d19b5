"""A Spark session with the settings the library's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """UTC clock, adaptive execution with skew handling; ``conf`` wins. On a cluster the master comes from the submit command."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
