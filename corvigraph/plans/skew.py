"""Joins of many rows with a table that has one row per key, whatever share of the rows one key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task; a key with more is spread over several.
HOT_ROWS = 1_000_000
#: Most keys that are spread: each of them holds at least this part of all rows, so the list has a fixed bound.
MOST_HOT = 1_000


def hot_keys(rows: DataFrame, keys: Sequence[str], least: int = HOT_ROWS) -> DataFrame:
    """(keys, salts): keys with more than ``least`` rows and at least a thousandth of all, at most MOST_HOT of them.

    Counted with a map-side step. A key below both bounds needs no spreading: with it a task holds at most
    ``least`` rows, or a thousandth of the table.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    hot = n.crossJoin(F.broadcast(total)).where((F.col("_n") > least) & (F.col("_n") * MOST_HOT >= F.col("_total")))
    return hot.select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_salts"))


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", least: int = HOT_ROWS, at_most: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row per key; ``how`` is inner or left.

    Rows of hot keys are dealt over salts by a hash of their other columns and the table's row is repeated
    for each salt. ``rows`` is read twice: give a written table. Where all rows are at most ``least`` no key
    can be hot, and it is a plain join; ``at_most`` is a bound of the rows that the caller knows, so that they
    need not be counted.
    """
    keys = list(keys)
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    if (at_most is not None and at_most <= least) or rows.count() <= least:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot_keys(rows, keys, least))
    others = [c for c in rows.columns if c not in keys] or keys
    many = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("_salts")))).drop("_salts")
    each = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1))).drop("_salts")
    return many.join(each, [*keys, "_salt"], how).drop("_salt")
