"""Mixing sources to target weights with capped repetition (problem 7).

Sizes are summed per source; repetition rates follow from the targets; each document is then used
floor(rate) times and once more where a number drawn from its id by a seeded hash is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """Sources are equal if their keys are: letter case, outer white space and blank, hyphen or underscore do not count."""
    return F.translate(F.lower(F.regexp_replace(source, r"(?U)\A\s+|\s+\z", "")), " -", "__")


def listed_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): documents with text of the listed sources, named as in ``targets``.

    ``targets`` is small by nature (a row per source named by hand), so Spark broadcasts it by its size;
    nothing forces that. Tokens are UTF-8 bytes of the text plus one.
    """
    names = targets.select("source", source_key(F.col("source")).alias("key")).groupBy("key").agg(F.min("source").alias("source"))
    docs = documents.where(F.col("text").isNotNull() & F.col("source").isNotNull()).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("tokens"), source_key(F.col("source")).alias("key"))
    return docs.join(names, "key").select("doc_id", "source", "tokens")


def source_rates(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_uses, documents, tokens, total, reachable, rate) for each listed source.

    A null or negative target counts as 0; a source with target 0 is reached at once and gets rate 0. A null max_uses counts as 1.
    total is the size T of all listed documents, and of the mix. A source that cannot reach its target
    even at max_uses gets rate max_uses; what it lacks is shared out over the others by their targets, as
    far as their own caps let them (water filling: with sources ordered by how soon they reach their cap
    as the level rises, the level is T less the capped, over the targets of the rest). Only the targets
    table is windowed. Sources without documents have tokens 0, rate 0.
    """
    sums = listed_documents(documents, targets).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    share, most = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.coalesce("max_uses", F.lit(1))
    t = targets.select("source", share.alias("target_share"), most.alias("max_uses")).join(sums, "source", "left").na.fill(0, ["documents", "tokens"])
    everywhere = Window.partitionBy(F.lit(1))
    soon = F.coalesce(F.try_divide("cap", "target_share"), F.lit(float("inf")))
    by_cap = everywhere.orderBy(soon, "source")
    t = t.withColumn("total", F.sum("tokens").over(everywhere)).withColumn("cap", F.col("max_uses") * F.col("tokens").cast("double"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("target_share").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = F.try_divide(F.greatest(F.lit(0.0), F.col("total") - F.col("capped")), "rest")
    # the level of the first source that its own cap does not stop; none: all are used up
    first = F.min(F.when(level * F.col("target_share") <= F.col("cap"), F.struct(soon, F.col("source"), level.alias("level")))).over(everywhere)
    t = t.withColumn("level", first["level"])
    amount = F.when(F.col("target_share") > 0, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("target_share"), F.col("cap")))).otherwise(0.0)
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_uses").cast("double"), amount / F.col("tokens"))).otherwise(F.lit(0.0))
    return t.select("source", "target_share", "max_uses", "documents", "tokens", "total", (F.col("cap") >= F.col("target_share") * F.col("total")).alias("reachable"), rate.alias("rate"))


def document_uses(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, uses) of every document of a listed source, also those used 0 times."""
    docs = listed_documents(documents, targets)
    rates = source_rates(documents, targets).select("source", "rate")
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    return docs.join(rates, "source").select("doc_id", "source", "tokens", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int").alias("uses"))


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(source, target_share, reachable, rate, used_tokens, share): the share each source really gets."""
    used = document_uses(documents, targets, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    out = source_rates(documents, targets).join(used, "source", "left").na.fill(0, ["used_tokens"])
    return out.select("source", "target_share", "reachable", "rate", "used_tokens", F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))).alias("share"))


def unreachable(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(source, target_share, used_tokens, share): sources whose every document is used as often as it may be and which still miss their target.

    Read off what :func:`document_uses` emits. A reachable source is never in it: its rate aims at no less
    than its target, and if all its documents are at max_uses it has all it can give, which is enough.
    """
    uses = document_uses(documents, targets, seed).join(targets.select("source", F.coalesce("max_uses", F.lit(1)).alias("most")), "source")
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum(F.col("tokens") * F.col("most")).alias("most_tokens"))
    t = source_rates(documents, targets).join(used, "source", "left").na.fill(0, ["used_tokens", "most_tokens"])
    return t.where((F.col("used_tokens") == F.col("most_tokens")) & (F.col("used_tokens") < F.col("target_share") * F.col("total"))).select("source", "target_share", "used_tokens", F.try_divide(F.col("used_tokens").cast("double"), "total").alias("share"))
