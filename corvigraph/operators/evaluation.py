"""Set-based comparison of two extractions of the same cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def precision_recall(tp: Column, predicted: Column, truth: Column, both_empty: float = 1.0) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) from sizes; with both sets empty all are ``both_empty``, with one empty 0."""
    none = (predicted == 0) & (truth == 0)
    p, r = F.when(none, both_empty).otherwise(ratio(tp, predicted, 0.0)), F.when(none, both_empty).otherwise(ratio(tp, truth, 0.0))
    return p, r, F.when(none, both_empty).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def compare_sets(cases: DataFrame, predicted: DataFrame, truth: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """(keys, tp, predicted, truth) for every case of ``cases``, also those with empty sets, in one aggregation over both sides."""
    cols = [*keys, *item]
    p = predicted.select(*cols, F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = truth.select(*cols, F.lit(0).alias("p"), F.lit(1).alias("t"))
    each = p.unionByName(t).groupBy(*cols).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    sums = each.groupBy(*keys).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("predicted"), F.sum("t").alias("truth"))
    return cases.select(*keys).distinct().join(sums, list(keys), "left").na.fill(0, ["tp", "predicted", "truth"])


def safety_counts(items: DataFrame, key: str) -> DataFrame:
    """Counts per case of status changes between truth and output.

    ``items`` (key, item, side, status): side 'findings', 'truth' or 'output', status 'present', 'absent'
    or 'uncertain'. Polarity flips are absent in truth and present in output; contradictions absent in
    findings and present in output; dropped, novel and missed compare present items. One pass, no joins.
    """
    flag = lambda side, status: F.max((F.col("side") == side) & (F.col("status") == status))
    each = items.groupBy(key, "item").agg(
        flag("truth", "present").alias("tp"), flag("truth", "absent").alias("ta"), flag("truth", "uncertain").alias("tu"),
        flag("output", "present").alias("op"), flag("output", "absent").alias("oa"), flag("output", "uncertain").alias("ou"),
        flag("findings", "present").alias("fp"), flag("findings", "absent").alias("fa"), flag("findings", "uncertain").alias("fu"),
    )
    n = lambda c: F.count_if(F.expr(c))
    out = each.groupBy(key).agg(
        n("ta AND op").alias("absent_to_present"), n("tp AND oa").alias("present_to_absent"), n("fa AND op").alias("contradictions"), n("tp AND NOT op").alias("dropped"), n("op AND NOT tp").alias("novel"), n("fp AND NOT op").alias("missed"),
        n("tp").alias("truth_present"), n("tp AND op").alias("kept"), n("ta").alias("truth_absent"), n("ta AND oa").alias("kept_absent"), n("tu").alias("truth_uncertain"), n("tu AND ou").alias("kept_uncertain"),
        n("fu").alias("findings_uncertain"), n("fu AND (op OR oa)").alias("resolved"),
    )
    return out.withColumns({
        "preservation": ratio(F.col("kept"), F.col("truth_present"), 1.0), "absent_preservation": ratio(F.col("kept_absent"), F.col("truth_absent"), 1.0),
        "uncertain_preservation": ratio(F.col("kept_uncertain"), F.col("truth_uncertain"), 1.0), "uncertain_resolution": ratio(F.col("resolved"), F.col("findings_uncertain"), 0.0),
    })


def weighted_drops(dropped: DataFrame, weights: DataFrame, key: str, item: str, weight: str, least: float = 0.1) -> DataFrame:
    """(key, important, mean, largest, total) of the weights of dropped items; an item without weight counts 0."""
    w = weights.groupBy(key, item).agg(F.max(weight).alias("w"))
    d = dropped.select(key, item).distinct().join(w, [key, item], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return d.groupBy(key).agg(F.count_if(F.col("w") > least).alias("important"), F.avg("w").alias("mean"), F.max("w").alias("largest"), F.sum("w").alias("total"))


def drop_priority(weight: Column) -> Column:
    return F.when(weight > 0.10, "high").when(weight > 0.05, "medium").otherwise("low")


def grounding(output: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``output`` triples (keys, src, relation, dst) with ``grounded``: in findings as they are or reversed."""
    cols = [*keys, "src", "relation", "dst"]
    there = findings.select(cols).union(findings.select(*keys, F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))).distinct().withColumn("hit", F.lit(True))
    return output.join(there, cols, "left").withColumn("grounded", F.coalesce("hit", F.lit(False))).drop("hit")


def refined_grounding(output: DataFrame, findings: DataFrame, entities: DataFrame, keys: Sequence[str], relation: str) -> DataFrame:
    """Triples of one relation with ``grounded``: the pair in findings in either direction, or both ends among the findings' entities."""
    o = output.where(F.col("relation") == relation)
    pair = findings.select(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct().withColumn("hit", F.lit(True))
    e = entities.select(*keys, "item").distinct()
    head, tail = e.select(*keys, F.col("item").alias("src"), F.lit(True).alias("h")), e.select(*keys, F.col("item").alias("dst"), F.lit(True).alias("t"))
    o = o.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(pair, [*keys, "lo", "hi"], "left").join(head, [*keys, "src"], "left").join(tail, [*keys, "dst"], "left")
    return o.withColumn("grounded", F.coalesce(F.col("hit"), F.lit(False)) | (F.col("h").isNotNull() & F.col("t").isNotNull())).drop("lo", "hi", "hit", "h", "t")


def grounding_rates(grounded: DataFrame, by: Sequence[str]) -> DataFrame:
    return grounded.groupBy(*by).agg(F.count_if("grounded").alias("grounded"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.col("grounded") / F.greatest("total", F.lit(1)))


def confidence(entities: Column, relations: Column, linked: Column, compounds: Column) -> Column:
    """0.5, and 0.2, 0.2, 0.1, 0.1 more for each of the four that is there, at most 1."""
    parts = [(0.2, entities > 0), (0.2, relations > 0), (0.1, linked), (0.1, compounds)]
    return F.least(F.lit(1.0), sum((w * c.cast("int") for w, c in parts), F.lit(0.5)))


def zone(alpha: Column) -> Column:
    """Fixed bounds of a layer's exponent: below 2 over-trained, to 6 well-trained, above under-trained."""
    return F.when(alpha < 2, "over").when(alpha <= 6, "well").when(alpha > 6, "under")


def zone_summary(layers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: mean, median, deviation, extremes and counts by zone."""
    long = layers.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("alpha")) for c in columns])).alias("x")).select("x.*").where("alpha IS NOT NULL")
    z = zone(F.col("alpha"))
    return long.groupBy("series").agg(F.avg("alpha").alias("mean"), F.percentile("alpha", F.lit(0.5)).alias("median"), F.stddev_samp("alpha").alias("std"), F.min("alpha").alias("low"), F.max("alpha").alias("high"), *[F.count_if(z == n).alias(n) for n in ("over", "well", "under")])


def throughput(items: Column, seconds: Column, target: float) -> tuple[Column, Column]:
    """(items per minute, hours for ``target`` items); null where nothing was timed."""
    per = F.try_divide(items.cast("double") * 60, seconds.cast("double"))
    return per, F.try_divide(F.lit(target), per * 60)


def projection(items: Column, seconds: Column, target: float, price: float) -> tuple[Column, Column, Column]:
    """(items per minute, hours for ``target`` items, what they cost at ``price`` an hour)."""
    per, hours = throughput(items, seconds, target)
    return per, hours, price * hours


def layer_actions(layers: DataFrame, rules: DataFrame, healthy: float = 6.0) -> DataFrame:
    """(projection, undertrained, degraded, layers, action): layers above ``healthy``, those that were below it before, and the rule's action.

    A degraded layer is to be investigated first; the rule (projection, action) speaks where any is undertrained.
    """
    weak, was = F.col("ft_alpha") > healthy, F.col("base_alpha") <= healthy
    s = layers.groupBy("projection").agg(F.count_if(weak).alias("undertrained"), F.count_if(weak & was).alias("degraded"), F.count(F.lit(1)).alias("layers"))
    s = s.join(rules.withColumnRenamed("action", "rule"), "projection", "left")
    action = F.when(F.col("degraded") > 0, "investigate block, consider leaving it out").when(F.col("undertrained") > 0, F.coalesce("rule", F.lit("no change"))).otherwise("no change")
    return s.select("projection", "undertrained", "degraded", "layers", action.alias("action"))


def roll_up(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, mean, total, largest, cases) of many metric columns, by one aggregation."""
    parts = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
    long = metrics.select(F.explode(parts).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.max("v").alias("largest"), F.count("v").alias("cases"))
