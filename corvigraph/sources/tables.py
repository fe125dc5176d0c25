"""The engine's tables: one Parquet file or folder per name below a base folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan ``base/name.parquet``. Filters and column choices made later reach the scan."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
