"""A session as the engine wants it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew joins; everything else as the cluster says."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.master(master) if master else builder
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
