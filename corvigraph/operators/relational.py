"""Relational building blocks with total orders and defined null handling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total for a defined result.

    Aggregates with a map-side partial step, so a hot key costs one row per task; null keys form a group.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """One row per key: of the largest ``score`` (null lowest), ties to the smallest ``ties``."""
    return first_per_key(df, keys, [F.col(score).isNull().cast("int"), -F.col(score), *[F.col(t) for t in ties]])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps only k rows per group and task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def with_share(df: DataFrame, count: str, name: str = "pct", digits: int = 1) -> DataFrame:
    """Adds the percentage of ``count`` in its total. The total is a one-row aggregate, not a global window."""
    total = df.agg(F.sum(count).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round(100.0 * F.col(count) / F.col("_total"), digits)).drop("_total")


def lookup(df: DataFrame, key: str, mapping: DataFrame, source: str, target: str, name: str, default: Column | None = None) -> DataFrame:
    """Dictionary lookup: ``mapping``'s target for df's key, else ``default`` (the key itself if not given)."""
    found = mapping.select(F.col(source).alias("_source"), F.col(target).alias("_target"))
    return df.join(found, F.col(key) == F.col("_source"), "left").withColumn(name, F.coalesce("_target", F.col(key) if default is None else default)).drop("_source", "_target")


def pairs_within(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, a, b), a < b: unordered pairs of distinct items of a group. The result is quadratic in a group by definition."""
    one = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    left, right = one.select(*keys, F.col(item).alias("a")), one.select(*keys, F.col(item).alias("b"))
    return left.join(right, list(keys)).where("a < b")


def canonical_pair(a: str, b: str) -> tuple[Column, Column]:
    """The two ends of an undirected pair in a fixed order."""
    return F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that do not); null counts as not passing, so that no row is lost."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, by column names; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nearest_to_median(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row whose value is nearest the exact median; ties to the smallest ``tie``. Empty input gives no row."""
    median = df.agg(F.percentile(value, F.lit(0.5)).alias("_median"))
    return df.crossJoin(F.broadcast(median)).where(F.col(value).isNotNull()).orderBy(F.abs(F.col(value) - F.col("_median")), tie).limit(1).drop("_median")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, count): equal-width bins between minimum and maximum, the maximum in the last bin; empty bins have no row."""
    edge = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def sample_by_hash(df: DataFrame, key: str, parts: int, keep: int = 1, seed: int = 42) -> DataFrame:
    """The same ``keep`` of ``parts`` shares of the keys on every run and cluster; all rows of a key go together."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)) < keep)


def sample_by_digest(df: DataFrame, key: str, parts: int, keep: int = 1, seed: int = 42) -> DataFrame:
    """:func:`sample_by_hash` by the MD5 of seed and key, which other engines can draw alike."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(draw % parts < keep)
