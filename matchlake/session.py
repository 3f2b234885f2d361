"""Spark sessions with the settings that the library's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "matchlake", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings may override (underscores stand for dots)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
