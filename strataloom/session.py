"""Session settings that every plan assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(name: str = "strataloom") -> SparkSession.Builder:
    """Adaptive execution with skew handling, UTC, Arrow; partition counts are left to the cluster."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
