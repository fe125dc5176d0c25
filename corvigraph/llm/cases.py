"""Current rows of rag_entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import normal_list_col


def version_key():
    """Order of a case's rows: processed_at (null first), then content, so that ties have one winner."""
    return F.struct("processed_at", "num_entities", F.to_json(F.struct("entities")).alias("content"))


def current_rows(rag: DataFrame) -> DataFrame:
    """(case_id, num_entities, terms): of each case the row of the latest processed_at.

    ``terms`` are the normal forms of the entity texts, in order, blank ones left out. ``max_by`` has a
    map-side partial step, so a case with a third of all rows costs one row per map task. Rows without
    case_id belong to no case and are left out; ties of processed_at go to the larger content.
    """
    best = (
        rag.where(F.col("case_id").isNotNull())
        .select("case_id", "num_entities", "processed_at", "entities")
        .groupBy("case_id")
        .agg(F.max_by(F.struct("num_entities", F.col("entities.text").alias("texts")), version_key()).alias("v"))
    )
    return best.select("case_id", "v.num_entities", normal_list_col("v.texts").alias("terms"))
