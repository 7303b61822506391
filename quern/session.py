"""A Spark session with the settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, name: str = "quern", **settings: str) -> SparkSession:
    """UTC time zone and adaptive execution; anything else comes from ``settings`` or the cluster."""
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return b.config(map=conf | settings).getOrCreate()
