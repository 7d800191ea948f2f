"""A session with the settings the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get(app: str = "genoloom", **conf: str) -> SparkSession:
    """The running session, or a new one: adaptive execution on, UTC, settings of ``conf`` on top."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
