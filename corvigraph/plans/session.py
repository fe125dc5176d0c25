"""A session with the settings the engine expects; a session made elsewhere works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "corvigraph", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with adaptive execution, UTC and Arrow. ``master`` None leaves the choice to spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()
