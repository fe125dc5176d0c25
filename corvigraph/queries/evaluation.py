"""Comparison of two extractions: sections stand for truth and output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import evaluation as V
from ..operators.relational import best_per_key, top_per_group
from ..registry import query
from ..sources.tables import table
from .graphs import REL, patient_edges
from .relational import ENTITIES, entity_rows

_SIDES = f"WITH {ENTITIES}, x AS (SELECT DISTINCT case_id, clean(text) AS item, CASE section WHEN 'findings' THEN 'findings' WHEN 'conclusions' THEN 'truth' WHEN 'recommendations' THEN 'output' END AS side, CASE assertion WHEN 'present' THEN 'present' WHEN 'absent' THEN 'absent' WHEN 'possible' THEN 'uncertain' END AS status FROM entity_rows WHERE text IS NOT NULL AND case_id IS NOT NULL)"


def sides(spark, base):
    """(case_id, item, side, status): conclusions as truth, recommendations as output."""
    side = F.when(F.col("section") == "findings", "findings").when(F.col("section") == "conclusions", "truth").when(F.col("section") == "recommendations", "output")
    status = F.when(F.col("assertion") == "present", "present").when(F.col("assertion") == "absent", "absent").when(F.col("assertion") == "possible", "uncertain")
    return entity_rows(spark, base).where("text IS NOT NULL").select("case_id", clean(F.col("text")).alias("item"), side.alias("side"), status.alias("status")).distinct()


_F1 = """c AS (SELECT DISTINCT case_id FROM rag_entities), p AS (SELECT DISTINCT case_id, item FROM x WHERE side = 'output'), t AS (SELECT DISTINCT case_id, item FROM x WHERE side = 'truth'),
s AS (SELECT c.case_id, (SELECT count(*) FROM p WHERE p.case_id = c.case_id) AS np, (SELECT count(*) FROM t WHERE t.case_id = c.case_id) AS nt, (SELECT count(*) FROM p JOIN t USING (case_id, item) WHERE case_id = c.case_id) AS tp FROM c),
f AS (SELECT case_id, CASE WHEN np + nt = 0 THEN 1.0 WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS p, CASE WHEN np + nt = 0 THEN 1.0 WHEN nt = 0 THEN 0 ELSE tp::DOUBLE / nt END AS r FROM s)"""


@query(f"{_SIDES}, {_F1} SELECT case_id, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM f")
def entity_f1(spark, base):
    x = sides(spark, base)
    s = V.compare_sets(table(spark, base, "rag_entities"), x.where("side = 'output'"), x.where("side = 'truth'"), ["case_id"], ["item"])
    p, r, f = V.precision_recall(F.col("tp"), F.col("predicted"), F.col("truth"))
    return s.select("case_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query(f"""WITH {REL}, p AS (SELECT g, src, dst FROM e WHERE relationship IN ('causes', 'treated with')), t AS (SELECT g, src, dst FROM e WHERE relationship IN ('causes', 'part of')), c AS (SELECT DISTINCT g FROM e),
s AS (SELECT c.g, (SELECT count(*) FROM p WHERE p.g = c.g) AS np, (SELECT count(*) FROM t WHERE t.g = c.g) AS nt, (SELECT count(*) FROM p JOIN t USING (g, src, dst) WHERE g = c.g) AS tp FROM c),
f AS (SELECT g, CASE WHEN np + nt = 0 THEN 1.0 WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS p, CASE WHEN np + nt = 0 THEN 1.0 WHEN nt = 0 THEN 0 ELSE tp::DOUBLE / nt END AS r FROM s) SELECT g, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM f""")
def relation_f1(spark, base):
    e = patient_edges(spark, base)
    s = V.compare_sets(e, e.where("relationship IN ('causes', 'treated with')"), e.where("relationship IN ('causes', 'part of')"), ["g"], ["src", "dst"])
    return s.select("g", F.round(V.precision_recall(F.col("tp"), F.col("predicted"), F.col("truth"))[2], 6).alias("f1"))


_FLAGS = "z AS (SELECT case_id, item, " + ", ".join(f"coalesce(bool_or(side = '{s}' AND status = '{t}'), false) AS {s[0]}{t[0]}" for s in ("truth", "output", "findings") for t in ("present", "absent", "uncertain")) + " FROM x GROUP BY 1, 2)"


@query(f"{_SIDES}, {_FLAGS} SELECT case_id, count(*) FILTER (ta AND op) AS absent_to_present, count(*) FILTER (tp AND oa) AS present_to_absent, count(*) FILTER (fa AND op) AS contradictions, count(*) FILTER (tp AND NOT op) AS dropped, count(*) FILTER (op AND NOT tp) AS novel, count(*) FILTER (fp AND NOT op) AS missed FROM z GROUP BY 1")
def safety_metrics(spark, base):
    return V.safety_counts(sides(spark, base), "case_id").select("case_id", "absent_to_present", "present_to_absent", "contradictions", "dropped", "novel", "missed")


@query(f"{_SIDES}, {_FLAGS} SELECT case_id, round(coalesce(count(*) FILTER (tp AND op)::DOUBLE / nullif(count(*) FILTER (tp), 0), 1), 6) AS preservation, round(coalesce(count(*) FILTER (ta AND oa)::DOUBLE / nullif(count(*) FILTER (ta), 0), 1), 6) AS absent_preservation, round(coalesce(count(*) FILTER (tu AND ou)::DOUBLE / nullif(count(*) FILTER (tu), 0), 1), 6) AS uncertain_preservation, round(coalesce(count(*) FILTER (fu AND (op OR oa))::DOUBLE / nullif(count(*) FILTER (fu), 0), 0), 6) AS uncertain_resolution FROM z GROUP BY 1")
def certainty_metrics(spark, base):
    names = ["preservation", "absent_preservation", "uncertain_preservation", "uncertain_resolution"]
    return V.safety_counts(sides(spark, base), "case_id").select("case_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"{_SIDES}, {_FLAGS}, w AS (SELECT case_id, clean(text) AS item, max(score) AS w FROM entity_rows WHERE section = 'findings' AND text IS NOT NULL GROUP BY 1, 2), d AS (SELECT z.case_id, coalesce(w.w, 0) AS w FROM z LEFT JOIN w USING (case_id, item) WHERE tp AND NOT op) SELECT case_id, count(*) FILTER (w > 0.1) AS important, round(avg(w), 6) AS mean, max(w) AS largest, round(sum(w), 6) AS total, CASE WHEN max(w) > 0.1 THEN 'high' WHEN max(w) > 0.05 THEN 'medium' ELSE 'low' END AS priority FROM d GROUP BY 1")
def weighted_drop_metrics(spark, base):
    """Dropped items weighted by their score in findings; 0 for those that are not there."""
    x = sides(spark, base)
    present = lambda side: x.where((F.col("side") == side) & (F.col("status") == "present")).select("case_id", "item").distinct()
    dropped = present("truth").join(present("output"), ["case_id", "item"], "left_anti")
    weights = entity_rows(spark, base).where("section = 'findings' AND text IS NOT NULL").select("case_id", clean(F.col("text")).alias("item"), "score")
    d = V.weighted_drops(dropped, weights, "case_id", "item", "score")
    return d.select("case_id", "important", F.round("mean", 6).alias("mean"), "largest", F.round("total", 6).alias("total"), V.drop_priority(F.col("largest")).alias("priority"))


_GR = f"WITH {REL}, o AS (SELECT g, src, relationship AS relation, dst FROM e WHERE relationship <> 'causes'), f AS (SELECT DISTINCT src, dst FROM e WHERE relationship = 'causes')"


@query(_GR + ", y AS (SELECT o.*, EXISTS (SELECT 1 FROM f WHERE (f.src = o.src AND f.dst = o.dst) OR (f.src = o.dst AND f.dst = o.src)) AS grounded FROM o) SELECT relation, count(*) FILTER (grounded) AS grounded, count(*) AS total, round(count(*) FILTER (grounded)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM y GROUP BY 1")
def relation_grounding(spark, base):
    """Relations whose pair of ends stands in a causal relation of any patient, in either direction."""
    e = patient_edges(spark, base).withColumnRenamed("relationship", "relation")
    found = e.where("relation = 'causes'").select("src", "dst").distinct().withColumn("relation", F.lit("any"))
    out = e.where("relation != 'causes'").withColumnsRenamed({"relation": "kind"}).withColumn("relation", F.lit("any"))
    return V.grounding_rates(V.grounding(out, found, []).withColumn("relation", F.col("kind")), ["relation"]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {REL}, o AS (SELECT g, src, dst FROM e WHERE relationship = 'located in'), f AS (SELECT g, src, dst FROM e WHERE relationship <> 'located in'), n AS (SELECT g, src AS item FROM f UNION SELECT g, dst FROM f) SELECT o.g, o.src, o.dst, EXISTS (SELECT 1 FROM f WHERE f.g = o.g AND ((f.src = o.src AND f.dst = o.dst) OR (f.src = o.dst AND f.dst = o.src))) OR (EXISTS (SELECT 1 FROM n WHERE n.g = o.g AND n.item = o.src) AND EXISTS (SELECT 1 FROM n WHERE n.g = o.g AND n.item = o.dst)) AS grounded FROM o")
def located_grounding(spark, base):
    e = patient_edges(spark, base).withColumnRenamed("relationship", "relation")
    f = e.where("relation != 'located in'")
    items = f.select("g", F.explode(F.array("src", "dst")).alias("item"))
    return V.refined_grounding(e, f, items, ["g"], "located in").select("g", "src", "dst", "grounded")


_EVAL = "ev AS (SELECT l_returnflag AS pipeline, l_orderkey AS case_id, avg(1 - l_discount * 5) AS f1, avg(l_tax * 10) AS recall FROM lineitem GROUP BY 1, 2)"


def _runs(spark, base):
    return table(spark, base, "lineitem").groupBy(F.col("l_returnflag").alias("pipeline"), F.col("l_orderkey").alias("case_id")).agg(F.avg(1 - F.col("l_discount") * 5).alias("f1"), F.avg(F.col("l_tax") * 10).alias("recall"))


@query(f"WITH {_EVAL} SELECT pipeline, round(avg(f1), 3) AS f1_mean, round(stddev_samp(f1), 3) AS f1_std, round(avg(recall), 3) AS recall_mean, round((avg(f1) + avg(recall)) / 2, 3) AS overall FROM ev GROUP BY 1 ORDER BY overall DESC")
def pipeline_kpis(spark, base):
    return _runs(spark, base).groupBy("pipeline").agg(F.round(F.avg("f1"), 3).alias("f1_mean"), F.round(F.stddev_samp("f1"), 3).alias("f1_std"), F.round(F.avg("recall"), 3).alias("recall_mean"), F.round((F.avg("f1") + F.avg("recall")) / 2, 3).alias("overall")).orderBy(F.desc("overall"))


@query(f"WITH {_EVAL}, m AS (SELECT pipeline, avg(f1) AS f1, avg(recall) AS recall FROM ev GROUP BY 1) SELECT 'f1' AS metric, arg_max(pipeline, f1) AS best FROM m UNION ALL SELECT 'recall', arg_max(pipeline, recall) FROM m")
def best_pipeline(spark, base):
    m = _runs(spark, base).groupBy("pipeline").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"))
    long = m.unpivot(["pipeline"], ["f1", "recall"], "metric", "value")
    return best_per_key(long, ["metric"], "value", ["pipeline"]).select("metric", F.col("pipeline").alias("best"))


@query(f"WITH {_EVAL} SELECT case_id FROM ev GROUP BY 1 HAVING max(f1) < 0.6501")
def consistent_failures(spark, base):
    return _runs(spark, base).groupBy("case_id").agg(F.max("f1").alias("best")).where("best < 0.6501").select("case_id")


@query(f"WITH {_EVAL} SELECT a.case_id, round(b.f1 - a.f1, 6) AS delta FROM ev a JOIN ev b ON a.case_id = b.case_id AND a.pipeline = 'A' AND b.pipeline = 'N' WHERE b.f1 - a.f1 > 0.1001")
def improvements(spark, base):
    r = _runs(spark, base)
    a, b = r.where("pipeline = 'A'").select("case_id", F.col("f1").alias("x")), r.where("pipeline = 'N'").select("case_id", F.col("f1").alias("y"))
    return a.join(b, "case_id").where("y - x > 0.1001").select("case_id", F.round(F.col("y") - F.col("x"), 6).alias("delta"))


_LAYERS = "layers AS (SELECT p_partkey AS layer_idx, p_type AS layer_name, p_retailprice / 250 AS base_alpha, p_retailprice / 250 - p_size / 40.0 AS ft_alpha FROM part)"


def _layers(spark, base):
    return table(spark, base, "part").select(F.col("p_partkey").alias("layer_idx"), F.col("p_type").alias("layer_name"), (F.col("p_retailprice") / 250).alias("base_alpha"), (F.col("p_retailprice") / 250 - F.col("p_size") / 40.0).alias("ft_alpha"))


@query(f"WITH {_LAYERS}, x AS (SELECT 'base_alpha' AS series, base_alpha AS a FROM layers UNION ALL SELECT 'ft_alpha', ft_alpha FROM layers) SELECT series, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS median, round(stddev_samp(a), 6) AS std, count(*) FILTER (a < 2) AS over, count(*) FILTER (a >= 2 AND a <= 6) AS well, count(*) FILTER (a > 6) AS under FROM x GROUP BY 1")
def layer_zones(spark, base):
    z = V.zone_summary(_layers(spark, base), ["base_alpha", "ft_alpha"])
    return z.select("series", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "over", "well", "under")


@query(f"WITH {_LAYERS} SELECT layer_idx, round(ft_alpha - base_alpha, 6) AS delta_alpha, round(abs(ft_alpha - base_alpha), 6) AS abs_delta FROM layers ORDER BY abs(ft_alpha - base_alpha) DESC, layer_idx LIMIT 20")
def layer_movers(spark, base):
    d = _layers(spark, base).withColumn("delta", F.col("ft_alpha") - F.col("base_alpha"))
    return d.orderBy(F.desc(F.abs("delta")), "layer_idx").limit(20).select("layer_idx", F.round("delta", 6).alias("delta_alpha"), F.round(F.abs("delta"), 6).alias("abs_delta"))


@query(f"WITH {_LAYERS} SELECT layer_name, count(*) AS weak FROM layers WHERE ft_alpha > 6 GROUP BY 1")
def layer_attribution(spark, base):
    return _layers(spark, base).where("ft_alpha > 6").groupBy("layer_name").agg(F.count(F.lit(1)).alias("weak"))


@query(f"WITH {ENTITIES}, c AS (SELECT case_id, count(*) AS n, max(score) AS best FROM entity_rows GROUP BY 1) SELECT case_id, n, best FROM (SELECT *, row_number() OVER (ORDER BY n DESC, case_id) AS rn FROM c WHERE best > 0.15) WHERE rn <= 20")
def review_queue(spark, base):
    c = entity_rows(spark, base).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return c.where("best > 0.15").orderBy(F.desc("n"), "case_id").limit(20)


@query("SELECT reader, reports, round(reports * 60.0::DOUBLE / secs, 6) AS per_minute FROM (SELECT reader, count(*) AS reports, date_diff('second', min(reported_at), max(reported_at)) AS secs FROM reports_lean WHERE reader IS NOT NULL GROUP BY 1) WHERE secs > 0")
def reader_throughput(spark, base):
    r = table(spark, base, "reports_lean").where("reader IS NOT NULL").groupBy("reader").agg(F.count(F.lit(1)).alias("reports"), F.timestamp_diff("SECOND", F.min("reported_at"), F.max("reported_at")).alias("secs"))
    return r.where("secs > 0").select("reader", "reports", F.round(V.throughput(F.col("reports"), F.col("secs"), 1e6)[0], 6).alias("per_minute"))
