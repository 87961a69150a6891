"""Session helper: settings that suit narrow text scans followed by small shuffles."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "codesieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
