"""Display preparation, synthetic cases, scores and joins not covered elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import clean
from ..operators import evaluation as V
from ..operators import graph as G
from ..operators import ontology as O  # noqa: E741
from ..plans.scratch import Scratch
from ..registry import query
from ..sources.tables import table
from .evaluation import _SIDES, sides
from .graphs import _LPA, KEYS, REL, patient_edges
from .relational import ENTITIES, entity_rows
from .resolution import _TERMS, terms

_COLOURS = {"present": "red", "absent": "green", "possible": "orange"}


@query(f"WITH {ENTITIES}, n AS (SELECT clean(text) AS label, arg_max(assertion, struct_pack(s := score, a := assertion)) AS status, count(*) AS n FROM entity_rows WHERE text IS NOT NULL AND score IS NOT NULL GROUP BY 1) SELECT label, 30 AS size, CASE status WHEN 'present' THEN 'red' WHEN 'absent' THEN 'green' WHEN 'possible' THEN 'orange' ELSE 'grey' END AS colour, round(100.0 * n / max(n) OVER (), 4)::DOUBLE AS scaled FROM n")
def display_columns(spark, base):
    """Label, size, colour by status and rank scaled to 100 of each node: what a plot needs."""
    n = entity_rows(spark, base).where("text IS NOT NULL AND score IS NOT NULL").groupBy(clean(F.col("text")).alias("label")).agg(F.max_by("assertion", F.struct("score", "assertion")).alias("status"), F.count(F.lit(1)).alias("n"))
    colour = F.lit("grey")
    for status, name in _COLOURS.items():
        colour = F.when(F.col("status") == status, name).otherwise(colour)
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("label", F.lit(30).alias("size"), colour.alias("colour"), F.round(100.0 * F.col("n") / F.col("most"), 4).alias("scaled"))


@query("SELECT coalesce(r.case_id, e.case_id) AS case_id, r.n AS reports, e.n AS extractions FROM (SELECT case_id, count(*) AS n FROM reports_lean GROUP BY 1) r FULL JOIN (SELECT case_id, count(*) AS n FROM rag_entities GROUP BY 1) e ON r.case_id = e.case_id")
def full_outer_join(spark, base):
    r = table(spark, base, "reports_lean").groupBy("case_id").agg(F.count(F.lit(1)).alias("reports"))
    e = table(spark, base, "rag_entities").groupBy("case_id").agg(F.count(F.lit(1)).alias("extractions"))
    return r.join(e, "case_id", "full")


@query()
def approximate_aggregates(spark, base):
    """Sketch forms of distinct counts and quantiles, for tables where exact ones cost too much."""
    return table(spark, base, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


@query(f"WITH {_TERMS} SELECT term FROM terms WHERE (term LIKE '%fracture%' OR term IN ('vomiting', 'sneezing', 'collapse')) AND NOT regexp_matches(term, '^[0-9]+$')")
def term_predicates(spark, base):
    t = terms(spark, base)
    return t.where((F.col("term").contains("fracture") | F.col("term").isin("vomiting", "sneezing", "collapse")) & ~F.col("term").rlike("^[0-9]+$"))


# Contexts of the invented sentences.
_CONTEXTS = ["diabetes", "hypertension", "infection", "pain", "inflammation", "prevention", "treatment", "management", "therapy"]


@query(f"""WITH {_TERMS}, h AS (SELECT a.term AS p, b.term AS c, list_value('diabetes', 'hypertension', 'infection', 'pain', 'inflammation', 'prevention', 'treatment', 'management', 'therapy')[(('0x' || substring(md5(a.term || '>' || b.term), 1, 8))::BIGINT % 9)::INT + 1] AS x FROM terms a JOIN terms b ON a.term <> b.term AND contains(b.term, a.term))
SELECT 'direct_compound' AS case_type, 'Patient received ' || c AS text, [c] AS expected, [c] AS merged FROM h UNION ALL
SELECT 'discontinuous_compound', 'Patient received ' || p || ' for ' || x, [p, x], [p || ' for ' || x] FROM h UNION ALL
SELECT 'separate_conditions', 'Patient has ' || p || ' and ' || c, [p, c], [p, c] FROM h UNION ALL
SELECT 'context_dependent', 'Patient history of ' || p || ', currently managing ' || c, [p, c], [p, c] FROM h""")
def synthetic_cases(spark, base):
    """Labelled test sentences of four kinds made from every pair of a term and one that holds it; contexts are drawn by a hash of the pair."""
    p, c = F.col("parent"), F.col("child")
    draw = F.conv(F.substring(F.md5(F.concat(p, F.lit(">"), c)), 1, 8), 16, 10).cast("long") % len(_CONTEXTS)
    h = O.contained_terms(terms(spark, base), whole_words=False).withColumn("x", F.element_at(F.array(*map(F.lit, _CONTEXTS)), (draw + 1).cast("int")))
    case = lambda kind, text, expected, merged: F.struct(F.lit(kind).alias("case_type"), text.alias("text"), F.array(*expected).alias("expected"), F.array(*merged).alias("merged"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kinds = F.array(
        case("direct_compound", say("Patient received ", c), [c], [c]),
        case("discontinuous_compound", say("Patient received ", p, " for ", F.col("x")), [p, F.col("x")], [say(p, " for ", F.col("x"))]),
        case("separate_conditions", say("Patient has ", p, " and ", c), [p, c], [p, c]),
        case("context_dependent", say("Patient history of ", p, ", currently managing ", c), [p, c], [p, c]),
    )
    return h.select(F.explode(kinds).alias("k")).select("k.*")


@query(_LPA + ", s AS (SELECT DISTINCT g, src AS id FROM e WHERE relationship = 'causes'), x AS (SELECT l5.g, l5.community, count(s.id) > 0 AS hit FROM l5 LEFT JOIN s ON s.g = l5.g AND s.id = l5.id GROUP BY 1, 2) SELECT g, round(avg(hit::INT), 6) AS coverage FROM x GROUP BY g")
def community_coverage(spark, base):
    """Share of a graph's communities with at least one member among the causes."""
    e = patient_edges(spark, base)
    c = G.label_propagation(e, Scratch(spark, "coverage"), KEYS)
    s = e.where("relationship = 'causes'").select("g", F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1))
    x = c.join(s, ["g", "id"], "left").groupBy("g", "community").agg((F.count("hit") > 0).cast("int").alias("hit"))
    return x.groupBy("g").agg(F.round(F.avg("hit"), 6).alias("coverage"))


@query("WITH w AS (SELECT rel_id, string_split(clean(source_entity_name), ' ') AS w FROM clinical_relationships WHERE source_entity_name IS NOT NULL), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS compound FROM w) SELECT compound, count(*) AS n FROM b GROUP BY 1")
def bigram_compounds(spark, base):
    """Neighbouring words as compounds: the fallback where no parser is plugged in."""
    w = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL").select(F.split(clean(F.col("source_entity_name")), " ").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    return w.where("size(w) > 1").select(F.explode(pairs).alias("compound")).groupBy("compound").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TERMS}, {ENTITIES}, tr AS (SELECT DISTINCT clean(source_entity_name) AS term FROM clinical_relationships WHERE clean(relationship_type) = 'causes'), e AS (SELECT DISTINCT case_id, clean(text) AS term, score FROM entity_rows WHERE text IS NOT NULL AND score IS NOT NULL), r AS (SELECT e.*, least(1.0, 0.4 * (term IN (SELECT term FROM terms))::INT + 0.4 * (term IN (SELECT term FROM tr))::INT + 0.2 * contains(term, ' of the ')::INT)::DOUBLE AS relevance FROM e) SELECT case_id, term, round(relevance, 6) AS relevance, round(least(1.0, score + 0.3::DOUBLE * relevance), 6)::DOUBLE AS boosted FROM r")
def ontology_boost(spark, base):
    """Relevance of each entity by three kinds of hit, and its confidence raised by it."""
    known = terms(spark, base).withColumn("m", F.lit(True))
    causes = table(spark, base, "clinical_relationships").where(clean(F.col("relationship_type")) == "causes").select(clean(F.col("source_entity_name")).alias("term")).distinct().withColumn("t", F.lit(True))
    e = entity_rows(spark, base).where("text IS NOT NULL AND score IS NOT NULL").select("case_id", clean(F.col("text")).alias("term"), "score").distinct()
    r = e.join(known, "term", "left").join(causes, "term", "left")
    rel = O.relevance(F.col("m").isNotNull(), F.col("t").isNotNull(), F.col("term").contains(" of the "))
    return r.select("case_id", "term", F.round(rel, 6).alias("relevance"), F.round(O.boost(F.col("score"), rel), 6).alias("boosted"))


@query(rf"WITH {REL}, d AS (SELECT g, id, count(*) AS degree FROM (SELECT g, src AS id FROM e UNION ALL SELECT g, dst FROM e) GROUP BY g, id), m AS (SELECT g, max(degree) AS most FROM d GROUP BY g), c AS (SELECT rel.g, rel_id, dst, 1 - levenshtein(regexp_replace(src, '[^\x00-\x7F]', '?', 'g'), regexp_replace(dst, '[^\x00-\x7F]', '?', 'g'))::DOUBLE / greatest(length(src), length(dst)) AS sim FROM rel WHERE g IS NOT NULL AND length(src) > 0 AND length(dst) > 0) SELECT c.rel_id, round(0.6::DOUBLE * sim + 0.4::DOUBLE * coalesce(degree::DOUBLE / most, 0.1), 6) AS final FROM c LEFT JOIN d ON d.g = c.g AND d.id = c.dst LEFT JOIN m ON m.g = c.g")
def graph_rerank(spark, base):
    """Each relation's text likeness mixed with its target's degree in the graph."""
    from .graphs import relations

    d = G.degrees(patient_edges(spark, base), KEYS)
    most = d.groupBy("g").agg(F.max("degree").alias("most"))
    score = d.join(most, "g").select("g", F.col("id").alias("dst"), (F.col("degree") / F.col("most")).alias("graph"))
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    c = relations(spark, base).where("g IS NOT NULL AND length(src) > 0 AND length(dst) > 0").withColumn("sim", T.likeness(plain("src"), plain("dst")))
    return O.graph_rerank(c.join(score, ["g", "dst"], "left"), "sim", "graph").select("rel_id", F.round("final", 6).alias("final"))


@query(f"{_SIDES}, z AS (SELECT case_id, count(DISTINCT item) FILTER (side = 'output') AS merged, count(DISTINCT item) FILTER (side = 'findings') AS extracted, coalesce(bool_or(contains(item, ' of the ')), false) AS compound FROM x GROUP BY 1) SELECT case_id, merged > 0 AND merged < extracted AS discontinuous, merged = 1 AND extracted = 1 AS direct, round(least(1.0, 0.5 + 0.2 * (extracted > 0)::INT + 0.2 * (merged > 0)::INT + 0.1 * (merged < extracted)::INT + 0.1 * compound::INT), 6)::DOUBLE AS confidence FROM z")
def merge_success(spark, base):
    """Per case: was merging successful, and the overall confidence."""
    z = sides(spark, base).groupBy("case_id").agg(F.count_distinct(F.when(F.col("side") == "output", F.col("item"))).alias("merged"), F.count_distinct(F.when(F.col("side") == "findings", F.col("item"))).alias("extracted"), F.coalesce(F.bool_or(F.col("item").contains(" of the ")), F.lit(False)).alias("compound"))
    m, x = F.col("merged"), F.col("extracted")
    return z.select("case_id", ((m > 0) & (m < x)).alias("discontinuous"), ((m == 1) & (x == 1)).alias("direct"), F.round(V.confidence(x, m, m < x, F.col("compound")), 6).alias("confidence"))


@query("""WITH r AS (SELECT rel_id, clean(source_entity_name) AS a, clean(target_entity_name) AS b, lower(coalesce(evidence, '')) AS t FROM clinical_relationships WHERE source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL)
SELECT rel_id, CASE WHEN regexp_matches(t, 'prevent|against|protect') THEN b || ' prevention' WHEN regexp_matches(t, 'treat|resolved|started on') AND (b LIKE '%vet' OR b LIKE '%ran' OR b LIKE '%ril' OR b LIKE '%tide') THEN a || ' on ' || b ELSE a END AS merged,
round(CASE WHEN regexp_matches(t, 'prevent|against|protect') THEN 0.8 WHEN regexp_matches(t, 'treat|resolved|started on') AND (b LIKE '%vet' OR b LIKE '%ran' OR b LIKE '%ril' OR b LIKE '%tide') THEN 0.75 ELSE 0.5 END, 2)::DOUBLE AS score FROM r""")
def merge_cascade(spark, base):
    """Clinical merging by rules, first match: prevention, medication for a condition, else the entity stays."""
    r = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL")
    r = r.select("rel_id", clean(F.col("source_entity_name")).alias("a"), clean(F.col("target_entity_name")).alias("b"), F.lower(F.coalesce("evidence", F.lit(""))).alias("t"))
    prevents = F.col("t").rlike("prevent|against|protect")
    treats = F.col("t").rlike("treat|resolved|started on") & F.col("b").rlike("(?:vet|ran|ril|tide)$")
    merged = F.when(prevents, F.concat("b", F.lit(" prevention"))).when(treats, F.concat("a", F.lit(" on "), "b")).otherwise(F.col("a"))
    return r.select("rel_id", merged.alias("merged"), F.when(prevents, 0.8).when(treats, 0.75).otherwise(0.5).alias("score"))


@query("""WITH a AS (SELECT rel_id, clean(source_entity_name) AS s, clean(target_entity_name) AS t, clean(relationship_type) AS k FROM clinical_relationships WHERE source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL),
known AS (SELECT DISTINCT least(s, t) AS lo, greatest(s, t) AS hi FROM a WHERE k = 'causes')
SELECT rel_id, CASE WHEN known.lo IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM a LEFT JOIN known ON known.lo = least(s, t) AND known.hi = greatest(s, t)""")
def relation_boost(spark, base):
    """Confidence 0.5, and 0.2 more where a causal relation links the same two ends in either direction."""
    a = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL")
    a = a.select("rel_id", clean(F.col("source_entity_name")).alias("s"), clean(F.col("target_entity_name")).alias("t"), clean(F.col("relationship_type")).alias("k"))
    a = a.withColumns({"lo": F.least("s", "t"), "hi": F.greatest("s", "t")})
    known = a.where("k = 'causes'").select("lo", "hi").distinct().withColumn("hit", F.lit(True))
    return a.join(known, ["lo", "hi"], "left").select("rel_id", F.round(F.least(F.lit(1.0), 0.5 + 0.2 * F.coalesce(F.col("hit"), F.lit(False)).cast("int")), 6).alias("confidence"))
