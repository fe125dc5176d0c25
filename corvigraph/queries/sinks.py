"""Graph files, ontology files, roll-ups, review lists and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean, likeness
from ..operators import evaluation as V
from ..operators import graph as G
from ..operators import resolution as E
from ..plans.scratch import Scratch
from ..registry import query
from ..sources import formats
from ..sources.tables import table
from .evaluation import _FLAGS, _LAYERS, _SIDES, _layers, sides
from .graphs import REL, patient_edges
from .relational import entity_rows


@query(f"WITH {REL}, m AS (SELECT DISTINCT src, dst FROM e) SELECT 'node' AS kind, id AS a, NULL::VARCHAR AS b FROM (SELECT src AS id FROM m UNION SELECT dst FROM m) UNION ALL SELECT 'edge', src, dst FROM m")
def graphml_round_trip(spark, base):
    """The merged graph written as GraphML, of any size, and read back line by line."""
    m = G.mega_graph(patient_edges(spark, base), "relationship")
    where = Scratch(spark, "graphml").path("graph")
    formats.write_graphml_parts(G.vertices_of(m, []), m, where)
    lines = spark.read.text(where)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&#13;"), F.lit("\r")), F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    node = lines.where("value LIKE '<node %'").select(F.lit("node").alias("kind"), plain(F.regexp_extract("value", '(?s)id="([^"]*)"', 1)).alias("a"), F.lit(None).cast("string").alias("b"))
    edge = lines.where("value LIKE '<edge %'").select(F.lit("edge").alias("kind"), plain(F.regexp_extract("value", '(?s)source="([^"]*)"', 1)).alias("a"), plain(F.regexp_extract("value", '(?s)target="([^"]*)"', 1)).alias("b"))
    return node.unionByName(edge)


@query(f"WITH {REL} SELECT DISTINCT src AS subject, CASE relationship WHEN 'causes' THEN 'may_cause' ELSE 'may_be_caused_by' END AS predicate, dst AS object FROM e WHERE relationship IN ('causes', 'is a symptom of') AND NOT regexp_matches(src || dst, '[\\s]{{2}}|[\\n\\r\\t]')")
def rdf_round_trip(spark, base):
    """Causes and symptoms as an RDF/XML ontology, written and read back as triples."""
    e = patient_edges(spark, base).where("relationship IN ('causes', 'is a symptom of')").where(r"NOT concat(src, dst) RLIKE '[\\s]{2}|[\\n\\r\\t]'")
    t = e.select("src", F.when(F.col("relationship") == "causes", "may_cause").otherwise("may_be_caused_by").alias("p"), "dst").distinct()
    where = Scratch(spark, "rdf").path("ontology")
    formats.write_rdf_triples(t, where)
    return formats.read_rdf_triples(spark, where).distinct()


@query(r"""WITH s AS (SELECT DISTINCT clean(source_entity_name) AS k, clean(target_entity_name) AS i FROM clinical_relationships WHERE length(clean(source_entity_name)) > 0 AND length(clean(target_entity_name)) > 0), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2),
x AS (SELECT a, b, c / (na.n + nb.n - c) AS j, 1 - levenshtein(regexp_replace(a, '[^\x00-\x7F]', '?', 'g'), regexp_replace(b, '[^\x00-\x7F]', '?', 'g'))::DOUBLE / greatest(length(a), length(b)) AS t,
  CASE WHEN string_split(a, ' ')[-1] <> string_split(b, ' ')[-1] THEN 0.2 ELSE 0 END AS p FROM c JOIN n na ON na.k = a JOIN n nb ON nb.k = b)
SELECT a, b, round(greatest(0, 0.5 * j + 0.5 * t - p), 6)::DOUBLE AS final FROM x""")
def final_scores(spark, base):
    """Pairs of names that share a neighbour: neighbour and text likeness in equal parts, less 0.2 where their last words differ."""
    r = table(spark, base, "clinical_relationships").select(clean(F.col("source_entity_name")).alias("k"), clean(F.col("target_entity_name")).alias("i")).where("length(k) > 0 AND length(i) > 0")
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    s = E.set_likeness(r, "k", "i").withColumn("likeness", likeness(plain("a"), plain("b"))).withColumn("penalty", F.when(last("a") != last("b"), 0.2).otherwise(0.0))
    return s.select("a", "b", F.round(E.final_score(penalty="penalty"), 6).alias("final"))


@query("""SELECT reader, round(reports * 60.0::DOUBLE / secs, 6) AS per_minute, round(1.7e6 / (reports * 60.0::DOUBLE / secs) / 60, 3) AS hours, round(16 * (1.7e6 / (reports * 60.0::DOUBLE / secs) / 60), 2) AS cost
FROM (SELECT reader, count(*) AS reports, date_diff('second', min(reported_at), max(reported_at)) AS secs FROM reports_lean WHERE reader IS NOT NULL GROUP BY 1) WHERE secs > 0""")
def throughput_costs(spark, base):
    """Per reader: reports a minute, and hours and cost (16 an hour) of 1.7 million at that rate."""
    r = table(spark, base, "reports_lean").where("reader IS NOT NULL").groupBy("reader").agg(F.count(F.lit(1)).alias("reports"), F.timestamp_diff("SECOND", F.min("reported_at"), F.max("reported_at")).alias("secs")).where("secs > 0")
    per, hours, cost = V.projection(F.col("reports"), F.col("secs"), 1.7e6, 16.0)
    return r.select("reader", F.round(per, 6).alias("per_minute"), F.round(hours, 3).alias("hours"), F.round(cost, 2).alias("cost"))


@query(f"{_SIDES}, {_FLAGS}, w AS (SELECT case_id, clean(text) AS item, max(score) AS w FROM entity_rows WHERE section = 'findings' AND text IS NOT NULL GROUP BY 1, 2), d AS (SELECT z.case_id, coalesce(w.w, 0) AS w FROM z LEFT JOIN w USING (case_id, item) WHERE tp AND NOT op), s AS (SELECT case_id, max(w) AS importance, sum(w) AS dropped FROM d GROUP BY 1) SELECT case_id, round(importance, 6) AS importance, round(dropped, 6) AS dropped, dropped > 0.15 AS alert FROM s WHERE importance > 0 ORDER BY round(importance, 6) DESC, case_id LIMIT 50")
def review_alerts(spark, base):
    """The fifty cases whose dropped findings weigh most, with an alert where they weigh more than 0.15 together."""
    x = sides(spark, base)
    present = lambda side: x.where((F.col("side") == side) & (F.col("status") == "present")).select("case_id", "item").distinct()
    dropped = present("truth").join(present("output"), ["case_id", "item"], "left_anti")
    weights = entity_rows(spark, base).where("section = 'findings' AND text IS NOT NULL").select("case_id", clean(F.col("text")).alias("item"), "score")
    d = V.weighted_drops(dropped, weights, "case_id", "item", "score").where("largest > 0")
    return d.select("case_id", F.round("largest", 6).alias("importance"), F.round("total", 6).alias("dropped"), (F.col("total") > 0.15).alias("alert")).orderBy(F.desc("importance"), "case_id").limit(50)


@query(f"WITH {_LAYERS}, k AS (SELECT CASE (layer_idx % 4)::INT WHEN 0 THEN 'v_proj' WHEN 1 THEN 'k_proj' WHEN 2 THEN 'up_proj' ELSE 'down_proj' END AS projection, base_alpha, ft_alpha FROM layers), s AS (SELECT projection, count(*) FILTER (ft_alpha > 6) AS undertrained, count(*) FILTER (base_alpha <= 6 AND ft_alpha > 6) AS degraded, count(*) AS layers FROM k GROUP BY 1) SELECT projection, undertrained, degraded, layers, CASE WHEN degraded > 0 THEN 'investigate block, consider leaving it out' WHEN undertrained > 0 AND projection IN ('v_proj', 'k_proj') THEN 'raise rank to 32-64' ELSE 'no change' END AS action FROM s")
def layer_actions(spark, base):
    """Unhealthy layers of each projection and what the rule table says to do."""
    kinds = F.element_at(F.array(*map(F.lit, ["v_proj", "k_proj", "up_proj", "down_proj"])), (F.col("layer_idx") % 4 + 1).cast("int"))
    rules = spark.createDataFrame([("v_proj", "raise rank to 32-64"), ("k_proj", "raise rank to 32-64"), ("up_proj", "no change"), ("down_proj", "no change")], "projection string, action string")
    return V.layer_actions(_layers(spark, base).withColumn("projection", kinds), rules)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS due, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS age, extract(year FROM o_orderdate)::INT AS year, extract(quarter FROM o_orderdate)::INT AS quarter,
isodow(o_orderdate)::INT AS weekday, CAST(last_day(o_orderdate) AS DATE) AS month_end, strftime(o_orderdate, '%Y-%m') AS label FROM orders""")
def date_functions(spark, base):
    d = F.to_date("o_orderdate")
    return table(spark, base, "orders").select(
        "o_orderkey", d.alias("day"), F.trunc(d, "month").alias("month"), F.date_add(d, 90).alias("due"), F.datediff(F.lit("1998-12-31").cast("date"), d).cast("long").alias("age"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        (F.weekday(d) + 1).alias("weekday"), F.last_day(d).alias("month_end"), F.date_format("o_orderdate", "yyyy-MM").alias("label"),
    )


_METRICS = ["absent_to_present", "present_to_absent", "contradictions", "dropped", "novel", "missed", "preservation", "absent_preservation", "uncertain_preservation", "uncertain_resolution"]


@query(f"""{_SIDES}, {_FLAGS}, c AS (SELECT case_id, count(*) FILTER (ta AND op) AS absent_to_present, count(*) FILTER (tp AND oa) AS present_to_absent, count(*) FILTER (fa AND op) AS contradictions, count(*) FILTER (tp AND NOT op) AS dropped, count(*) FILTER (op AND NOT tp) AS novel, count(*) FILTER (fp AND NOT op) AS missed,
coalesce(count(*) FILTER (tp AND op)::DOUBLE / nullif(count(*) FILTER (tp), 0), 1) AS preservation, coalesce(count(*) FILTER (ta AND oa)::DOUBLE / nullif(count(*) FILTER (ta), 0), 1) AS absent_preservation, coalesce(count(*) FILTER (tu AND ou)::DOUBLE / nullif(count(*) FILTER (tu), 0), 1) AS uncertain_preservation, coalesce(count(*) FILTER (fu AND (op OR oa))::DOUBLE / nullif(count(*) FILTER (fu), 0), 0) AS uncertain_resolution FROM z GROUP BY 1),
d AS (SELECT * FROM c WHERE NOT case_id LIKE 'DEMO_%'), u AS (UNPIVOT (SELECT {', '.join(f'{m}::DOUBLE AS {m}' for m in _METRICS)} FROM d) ON {', '.join(_METRICS)} INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, round(sum(v), 4) AS total, round(max(v), 6) AS largest, count(*) AS cases FROM u GROUP BY 1""")
def metric_rollup(spark, base):
    """Mean, sum and maximum of every comparison metric over the cases that are no demonstration."""
    m = V.safety_counts(sides(spark, base), "case_id").where("NOT case_id LIKE 'DEMO_%'")
    return V.roll_up(m, _METRICS).select("metric", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), F.round("largest", 6).alias("largest"), "cases")
