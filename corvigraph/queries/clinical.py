"""Clinical term rules: classes, bounds of relations, compounds of a case and what becomes of its entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import clean
from ..operators import compounds as C
from ..operators import ontology as O  # noqa: E741
from ..plans.scratch import Scratch
from ..registry import query
from ..sources.tables import table
from .relational import ENTITIES, entity_rows
from .resolution import _TERMS, terms

# --- cases: their text and entities

_CASES = f"""WITH RECURSIVE {_TERMS}, {ENTITIES},
txt AS MATERIALIZED (SELECT case_id, arg_max(coalesce(findings, '') || ' ' || coalesce(conclusions, ''), report_id) AS text FROM reports_lean WHERE case_id IS NOT NULL GROUP BY 1),
ce AS MATERIALIZED (SELECT DISTINCT case_id, clean(text) AS t FROM entity_rows WHERE length(clean(text)) > 0 AND case_id IS NOT NULL)"""


def case_texts(spark, base):
    """(case_id, text): findings and conclusions of each case's last report."""
    r = table(spark, base, "reports_lean").where("case_id IS NOT NULL")
    text = F.concat(F.coalesce("findings", F.lit("")), F.lit(" "), F.coalesce("conclusions", F.lit("")))
    return r.groupBy("case_id").agg(F.max_by(text, "report_id").alias("text"))


def case_entities(spark, base):
    e = entity_rows(spark, base).where("case_id IS NOT NULL").select("case_id", clean(F.col("text")).alias("t"), "section", "score")
    return e.where("length(t) > 0")


# --- classes and bounds

_WORDS_OF = {
    "entity": [("MEDICATION", "drug|medicine|medication|therapeutic"), ("PROCEDURE", "procedure|surgery|operation|intervention"), ("CONDITION", "disease|disorder|condition|syndrome"), ("VACCINE", "vaccine|vaccination|immunization"), ("ANATOMY", "muscle|bone|tissue|organ|eyelid"), ("FINDING", "finding|observation|symptom")],
    "concept": [("VACCINE", "vaccine|vaccination|immunization"), ("MEDICATION", "medication|drug|medicine"), ("CONDITION", "disease|infection|virus|condition"), ("PROCEDURE", "procedure|surgery|operation"), ("FINDING", "finding|symptom|observation"), ("ANATOMY", "eyelid|muscle|tissue|organ")],
}


def _case(column: str, which: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{words}') THEN '{name}'" for name, words in _WORDS_OF[which]) + f" ELSE '{default}' END"


@query(f"""WITH x AS (SELECT clean(e.text) AS term FROM (SELECT unnest(entities) AS e FROM rag_entities) UNION ALL SELECT clean(source_entity_name) FROM clinical_relationships UNION ALL SELECT clean(k) FROM (SELECT unnest(map_keys(entity_map)) AS k FROM resolved_entities))
SELECT term, {_case('term', 'entity', 'GENERAL')} AS entity_type, {_case('term', 'concept', 'MEDICAL_CONCEPT')} AS concept_type, regexp_matches(term, 'eyelid|cardiac|muscle|tissue|organ') AS anatomy, regexp_matches(term, 'finding|thickened|observation|symptom') AS finding, count(*) AS n
FROM x WHERE length(term) > 0 GROUP BY ALL""")
def term_classes(spark, base):
    """Every term of three tables with its entity and concept type (the first that fits) and two of the plain tests."""
    e = entity_rows(spark, base).select(clean(F.col("text")).alias("term"))
    r = table(spark, base, "clinical_relationships").select(clean(F.col("source_entity_name")).alias("term"))
    m = table(spark, base, "resolved_entities").select(F.explode(F.map_keys("entity_map")).alias("k")).select(clean(F.col("k")).alias("term"))
    n = e.unionAll(r).unionAll(m).where("length(term) > 0").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("term")
    return n.select("term", T.first_class(t, T.ENTITY_TYPES, "GENERAL").alias("entity_type"), T.first_class(t, T.CONCEPT_TYPES, "MEDICAL_CONCEPT").alias("concept_type"), T.has_test(t, "anatomy").alias("anatomy"), T.has_test(t, "finding").alias("finding"), "n")


_ENDS = f"""WITH {ENTITIES}, k AS (SELECT clean(text) AS t, CASE WHEN lower(category) = 'anatomy' THEN 'Anatomy' ELSE 'Observation' END || CASE assertion WHEN 'absent' THEN ' definitely absent' WHEN 'possible' THEN ' uncertain' ELSE ' definitely present' END AS label, count(*) AS n
  FROM entity_rows WHERE length(clean(text)) > 0 AND category IS NOT NULL GROUP BY 1, 2),
l AS (SELECT t, arg_max(label, struct_pack(n := n, l := label)) AS label FROM k GROUP BY 1),
r AS (SELECT rel_id, CASE lower(replace(trim(relationship_type), '_', ' ')) WHEN 'located in' THEN 'located_at' WHEN 'causes' THEN 'suggestive_of' ELSE 'modify' END AS type, clean(source_entity_name) AS s, clean(target_entity_name) AS o FROM clinical_relationships)"""


@query(f"""{_ENDS} SELECT rel_id, type, h.label AS head, t.label AS tail FROM r LEFT JOIN l h ON h.t = r.s LEFT JOIN l t ON t.t = r.o WHERE type = 'modify'
OR (type = 'suggestive_of' AND h.label IN ('Observation definitely present', 'Observation uncertain') AND t.label IN ('Observation definitely present', 'Observation uncertain'))
OR (type = 'located_at' AND h.label IN ('Observation definitely present', 'Observation uncertain', 'Observation definitely absent') AND t.label = 'Anatomy definitely present')""")
def type_constraints(spark, base):
    """Relations whose ends, by the kind and certainty the reports most often give them, may stand in them."""
    e = entity_rows(spark, base).where("length(text) > 0 AND category IS NOT NULL").select(clean(F.col("text")).alias("t"), F.lower("category").alias("c"), "assertion").where("length(t) > 0")
    kind = F.when(F.col("c") == "anatomy", "Anatomy").otherwise("Observation")
    sure = F.when(F.col("assertion") == "absent", " definitely absent").when(F.col("assertion") == "possible", " uncertain").otherwise(" definitely present")
    n = e.select("t", F.concat(kind, sure).alias("label")).groupBy("t", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = n.groupBy("t").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    k = F.lower(F.replace(F.trim("relationship_type"), F.lit("_"), F.lit(" ")))
    kind = F.when(k == "located in", "located_at").when(k == "causes", "suggestive_of").otherwise("modify")
    r = table(spark, base, "clinical_relationships").select("rel_id", kind.alias("type"), clean(F.col("source_entity_name")).alias("s"), clean(F.col("target_entity_name")).alias("o"))
    r = r.join(labels.select(F.col("t").alias("s"), F.col("label").alias("head")), "s", "left").join(labels.select(F.col("t").alias("o"), F.col("label").alias("tail")), "o", "left")
    return O.within_bounds(r, "type", "head", "tail", T.RELATION_ENDS).select("rel_id", "type", "head", "tail")


@query("""WITH m AS (SELECT patient_rowkey AS g, clean(e.key) AS k, min(clean(e.value.name)) AS name FROM (SELECT patient_rowkey, unnest(map_entries(entity_map)) AS e FROM resolved_entities) WHERE length(clean(e.value.name)) > 0 GROUP BY 1, 2)
SELECT rel_id, clean(source_entity_name) AS head, lower(trim(relationship_type)) AS relation, coalesce(m.name, 'UNKNOWN') AS tail FROM clinical_relationships c LEFT JOIN m ON m.g = c.patient_rowkey AND m.k = clean(c.target_entity_name) WHERE relationship_type IS NOT NULL AND target_entity_name IS NOT NULL""")
def triples_flatten(spark, base):
    """Relations as triples, the tail by the patient's own canonical name; UNKNOWN where there is none. Relations without a tail are left out."""
    m = table(spark, base, "resolved_entities").select(F.col("patient_rowkey").alias("g"), F.explode("entity_map").alias("k", "v")).select("g", clean(F.col("k")).alias("k"), clean(F.col("v.name")).alias("name"))
    m = m.where("length(name) > 0").groupBy("g", "k").agg(F.min("name").alias("name"))
    r = table(spark, base, "clinical_relationships").where("relationship_type IS NOT NULL AND target_entity_name IS NOT NULL").select("rel_id", F.col("patient_rowkey").alias("g"), clean(F.col("source_entity_name")).alias("head"), F.lower(F.trim("relationship_type")).alias("relation"), clean(F.col("target_entity_name")).alias("k"))
    return r.join(m, ["g", "k"], "left").select("rel_id", "head", "relation", F.coalesce("name", F.lit("UNKNOWN")).alias("tail"))


_MEDICAL = "vaccine|rabies|medication|treatment|procedure|surgery|therapy|diagnosis|condition|disease|symptom|finding|administration|patient|clinical|medical|pharmaceutical"


@query(f"""WITH r AS (SELECT rel_id, lower(evidence) AS x, clean(source_entity_name) AS a, clean(target_entity_name) AS b FROM clinical_relationships WHERE evidence IS NOT NULL AND length(clean(source_entity_name)) > 0 AND length(clean(target_entity_name)) > 0),
t AS (SELECT DISTINCT clean(source_entity_name) AS s, clean(target_entity_name) AS o, clean(relationship_type) AS p FROM clinical_relationships WHERE clean(relationship_type) IN ('part of', 'located in')),
k AS (SELECT a, b, min(replace(p, ' ', '_')) AS p FROM (SELECT DISTINCT a, b FROM r) JOIN t ON (contains(s, a) AND contains(o, b)) OR (contains(s, b) AND contains(o, a)) GROUP BY 1, 2),
q AS (SELECT rel_id, a, b, CASE WHEN regexp_matches(x, 'treat|for|manage') THEN CASE WHEN regexp_matches(a, '{_MEDICAL}') AND regexp_matches(b, '{_MEDICAL}') THEN 'treats' END
  WHEN regexp_matches(x, 'prevent|against') THEN 'prevents' WHEN regexp_matches(x, 'cause|due to') THEN 'causes' WHEN contains(a, b) OR contains(b, a) THEN 'part_of' END AS rule FROM r)
SELECT rel_id, coalesce(rule, k.p) AS kind, CASE WHEN rule = 'part_of' OR (rule IS NULL AND k.p IS NOT NULL) THEN 0.8 WHEN rule IS NOT NULL THEN 0.7 END::DOUBLE AS confidence FROM q LEFT JOIN k ON k.a = q.a AND k.b = q.b""")
def rule_relations(spark, base):
    """Type of each relation by the words of its evidence, else by a known triple ("part of", "located in") that holds both ends; null where neither says."""
    r = table(spark, base, "clinical_relationships")
    pairs = r.where("evidence IS NOT NULL").select("rel_id", F.col("evidence").alias("text"), clean(F.col("source_entity_name")).alias("a"), clean(F.col("target_entity_name")).alias("b")).where("length(a) > 0 AND length(b) > 0")
    known = r.select(clean(F.col("source_entity_name")).alias("subject"), clean(F.col("target_entity_name")).alias("object"), clean(F.col("relationship_type")).alias("predicate")).where("predicate IN ('part of', 'located in')")
    return O.rule_relations(pairs, known).select("rel_id", "kind", "confidence")


# --- matrices

_MATRIX = f"""{_CASES}, s AS (SELECT case_id, clean(text) AS t, list_distinct(list(section)) AS sections, max(score) AS w FROM entity_rows WHERE length(clean(text)) > 0 AND case_id IS NOT NULL GROUP BY 1, 2),
mp AS (SELECT a.case_id, a.t AS a, b.t AS b, CASE WHEN regexp_matches(a.t || ' ' || b.t, 'vaccine|medication|drug|therapy|treatment|procedure|surgery|diagnosis|condition|disease|syndrome') THEN 0.9 ELSE 0.6 END AS compound,
  CASE WHEN list_has_any(a.sections, b.sections) THEN a.w * b.w ELSE 0 END AS local, lower(text) AS x FROM s a JOIN s b ON a.case_id = b.case_id AND a.t <> b.t AND contains(b.t, a.t) LEFT JOIN txt ON txt.case_id = a.case_id),
tr AS (SELECT *, least(count(*) OVER (PARTITION BY p) / 100, 1) AS share FROM (SELECT DISTINCT clean(source_entity_name) AS s, clean(relationship_type) AS p, clean(target_entity_name) AS o FROM clinical_relationships WHERE relationship_type IS NOT NULL AND source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL)),
onto AS (SELECT a, b, least(sum(share), 1) AS ontology FROM (SELECT DISTINCT a, b FROM mp) JOIN tr ON (contains(s, a) AND contains(o, b)) OR (contains(s, b) AND contains(o, a)) GROUP BY 1, 2),
sc AS MATERIALIZED (SELECT case_id, least(mp.a, mp.b) AS i, greatest(mp.a, mp.b) AS j, 0.4 * compound + 0.3 * local + 0.2 * CASE WHEN strpos(x, mp.a) > 0 AND strpos(x, mp.b) > 0 THEN greatest(0, 1 - abs(strpos(x, mp.a) - strpos(x, mp.b)) / length(x)) ELSE 0 END + 0.1 * coalesce(ontology, 0) AS combined FROM mp LEFT JOIN onto ON onto.a = mp.a AND onto.b = mp.b)"""


def _matrix(spark, base, bar=None):
    r = table(spark, base, "clinical_relationships").where("relationship_type IS NOT NULL")
    triples = r.select(clean(F.col("source_entity_name")).alias("subject"), clean(F.col("relationship_type")).alias("predicate"), clean(F.col("target_entity_name")).alias("object"))
    return C.matrix_scores(case_texts(spark, base), case_entities(spark, base), triples, bar)


@query(_MATRIX + " SELECT case_id, i, j, round(combined, 6)::DOUBLE AS combined FROM sc")
def matrix_scores(spark, base):
    """Four matrices of a case's entities as one weighted sum, for entities of which one holds the other."""
    return _matrix(spark, base).select("case_id", "i", "j", F.round("combined", 6).alias("combined"))


@query(_MATRIX + """, lk AS (SELECT case_id, i, j FROM sc WHERE combined > 0.5 UNION SELECT case_id, j, i FROM sc WHERE combined > 0.5), rc AS (SELECT case_id, i, j FROM lk UNION SELECT rc.case_id, rc.i, lk.j FROM rc JOIN lk ON lk.case_id = rc.case_id AND lk.i = rc.j),
gp AS (SELECT case_id, i, array_to_string(list_sort(list_distinct(list_append(list(j), i))), ' + ') AS merged FROM rc GROUP BY 1, 2) SELECT case_id, i AS t, merged FROM gp""")
def matrix_merge(spark, base):
    """Entities linked by a score above 0.5 (the bar of 0.7 is met by hardly a pair of the test tables) under one phrase."""
    return C.merge_by_matrix(_matrix(spark, base), Scratch(spark, "matrix"), 0.5)


# --- compounds

_FIXED = """('vaccine', 'vaccine vaccination'), ('immunization', 'immunization vaccination'), ('drug', 'drug medication'), ('medicine', 'medicine medication'), ('therapeutic', 'therapeutic medication'), ('surgical', 'surgical surgery'), ('operation', 'operation surgery'), ('procedure', 'procedure surgery'),
('treatment', 'treatment therapy'), ('therapeutic', 'therapeutic therapy'), ('diagnostic', 'diagnostic diagnosis'), ('finding', 'finding diagnosis'), ('treatment', 'treatment management'), ('care', 'care management')"""
_CANDIDATES = f"""{_CASES}, hp AS (SELECT * FROM (SELECT a.term AS parent, b.term AS child FROM terms a JOIN terms b ON a.term <> b.term AND contains(b.term, a.term) UNION SELECT * FROM (VALUES {_FIXED})) WHERE length(parent) > 2 AND length(child) > length(parent)),
tw AS (SELECT DISTINCT term AS compound, unnest(list_filter(string_split(term, ' '), lambda w: w <> '')) AS word FROM terms WHERE length(term) > 5 AND len(list_filter(string_split(term, ' '), lambda w: w <> '')) > 1),
f1 AS (SELECT DISTINCT ce.case_id, hp.child AS compound FROM ce JOIN hp ON hp.parent = ce.t JOIN txt ON txt.case_id = ce.case_id WHERE contains(lower(text), hp.child)),
f2 AS (SELECT DISTINCT ce.case_id, compound FROM ce JOIN tw ON tw.word = ce.t WHERE length(word) > 2 AND word NOT IN ('and', 'for', 'of', 'or', 'the')),
fw AS (SELECT case_id, compound, unnest(list_filter(string_split(compound, ' '), lambda w: w <> '')) AS word FROM (SELECT * FROM f1 UNION SELECT * FROM f2)),
pa AS (SELECT fw.case_id, compound, list_sort(list(DISTINCT ce.t)) AS parts, count(*) AS hits FROM fw JOIN ce ON ce.case_id = fw.case_id AND contains(ce.t, word) GROUP BY 1, 2),
cd AS MATERIALIZED (SELECT f1.case_id, f1.compound, 'hierarchical_direct' AS method, 0.9::DOUBLE AS confidence, coalesce(parts, []) AS parts FROM f1 LEFT JOIN pa ON pa.case_id = f1.case_id AND pa.compound = f1.compound
UNION SELECT f2.case_id, f2.compound, 'medical_pattern', 0.8, parts FROM f2 JOIN pa ON pa.case_id = f2.case_id AND pa.compound = f2.compound WHERE hits >= 2
UNION SELECT a.case_id, a.t || ' ' || b.t, m, c, list_sort(list_distinct([a.t, b.t])) FROM (VALUES ('rabies|diabetes|infection|virus|disease', 'vaccine|vaccination|immunization', 'prevention|prevent|against', 'context_vaccine_disease', 0.85),
  ('diabetes|condition|disorder|syndrome', 'medication|drug|medicine|therapeutic', 'treatment|manage|for', 'context_condition_medication', 0.85), ('eyelid|cardiac|muscle|tissue|organ', 'finding|thickened|observation|symptom', '', 'context_anatomy_finding', 0.9)) r(one, two, cue, m, c)
  JOIN ce a ON regexp_matches(a.t, one) JOIN ce b ON b.case_id = a.case_id AND regexp_matches(b.t, two) JOIN txt ON txt.case_id = a.case_id AND regexp_matches(lower(text), cue))"""


def _entities(spark, base):
    return case_entities(spark, base).select("case_id", "t").distinct()


def _prepared(scratch, base):
    """(texts, entities) of the cases, written once: several steps read them."""
    return scratch.cut(case_texts(scratch.spark, base), "texts"), scratch.cut(_entities(scratch.spark, base), "entities")


def _candidates(scratch, base, texts, entities):
    known = scratch.cut(terms(scratch.spark, base), "terms")
    pairs = O.contained_terms(known, whole_words=False).unionByName(O.compound_pairs(scratch.spark))
    return scratch.cut(C.candidates(texts, entities, scratch.cut(pairs, "pairs"), known), "candidates")


@query(_CANDIDATES + " SELECT case_id, compound, method, confidence, parts FROM cd")
def compound_candidates(spark, base):
    """Compounds of each case by hierarchy (0.9), by words of longer terms (0.8) and by classes in context (0.85 to 0.9), with the entities that are their parts."""
    scratch = Scratch(spark, "candidates")
    return _candidates(scratch, base, *_prepared(scratch, base))


_SIMILAR = _CANDIDATES + r""", nn AS (SELECT case_id, count(*) + 1 AS n FROM cd GROUP BY 1),
xt AS (SELECT case_id, word, count(*) AS tf FROM (SELECT txt.case_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM txt JOIN nn ON nn.case_id = txt.case_id) GROUP BY 1, 2),
xc AS (SELECT case_id, compound, method, word, count(*) AS tf FROM (SELECT case_id, compound, method, unnest(regexp_extract_all(lower(compound), '[\p{L}\p{N}_]{2,}')) AS word FROM cd) GROUP BY ALL),
dfs AS (SELECT case_id, word, count(*) AS df FROM (SELECT case_id, word FROM xt UNION ALL SELECT case_id, word FROM xc) GROUP BY 1, 2),
idf AS (SELECT dfs.case_id, word, ln((1 + n) / (1 + df)) + 1 AS w FROM dfs JOIN nn ON nn.case_id = dfs.case_id),
nt AS (SELECT xt.case_id, sqrt(sum((tf * w) ** 2)) AS norm FROM xt JOIN idf ON idf.case_id = xt.case_id AND idf.word = xt.word GROUP BY 1),
dt AS (SELECT xc.case_id, compound, method, sum(coalesce(xt.tf, 0) * xc.tf * w * w) AS dot, sqrt(sum((xc.tf * w) ** 2)) AS norm FROM xc JOIN idf ON idf.case_id = xc.case_id AND idf.word = xc.word LEFT JOIN xt ON xt.case_id = xc.case_id AND xt.word = xc.word GROUP BY ALL),
sm AS MATERIALIZED (SELECT * FROM (SELECT cd.*, coalesce(dot / (dt.norm * nt.norm), 0) AS similarity, row_number() OVER (PARTITION BY cd.case_id ORDER BY round(coalesce(dot / (dt.norm * nt.norm), 0), 9) DESC, cd.compound, cd.method) AS rank
  FROM cd LEFT JOIN dt ON dt.case_id = cd.case_id AND dt.compound = cd.compound AND dt.method = cd.method LEFT JOIN nt ON nt.case_id = cd.case_id) WHERE rank <= 20)"""


def _similar(scratch, base, texts, entities):
    return scratch.cut(C.similar_candidates(_candidates(scratch, base, texts, entities), texts), "similar")


@query(_SIMILAR + " SELECT case_id, compound, method, round(similarity, 6)::DOUBLE AS similarity, rank::INTEGER AS rank FROM sm")
def similar_compounds(spark, base):
    """The twenty candidates of each case that are most like its text, by TF-IDF within the case."""
    scratch = Scratch(spark, "similar")
    return _similar(scratch, base, *_prepared(scratch, base)).select("case_id", "compound", "method", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def compound_resolution(spark, base):
    """Of each block of candidates that are alike the best by weighted score."""
    scratch = Scratch(spark, "resolution")
    texts, entities = _prepared(scratch, base)
    return C.best_of_blocks(_similar(scratch, base, texts, entities), texts)


_GRAPH_SCORE = """least(1, 0.3 + CASE WHEN contains(lower(text), compound) THEN 0.3 ELSE 0 END + CASE method WHEN 'hierarchical_direct' THEN 0.2 WHEN 'snomed_exact' THEN 0.15 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(compound, ' '), lambda w: w <> '')) >= 3 THEN 0.1 WHEN len(list_filter(string_split(compound, ' '), lambda w: w <> '')) >= 2 THEN 0.05 ELSE 0 END)"""
_SCORED = _SIMILAR + f", gs AS (SELECT case_id, compound, method, parts, {_GRAPH_SCORE} AS graph_score, 0.5 * similarity + 0.5 * {_GRAPH_SCORE} AS combined FROM (SELECT sm.*, coalesce(text, '') AS text FROM sm LEFT JOIN txt ON txt.case_id = sm.case_id))"


def _scored(scratch, base, texts, entities):
    s = _similar(scratch, base, texts, entities).join(texts, "case_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    s = s.withColumn("graph_score", C.graph_score(F.col("text"), F.col("compound"), F.col("method"))).drop("text")
    return s.withColumn("combined", 0.5 * F.col("similarity") + 0.5 * F.col("graph_score"))


@query(_SCORED + " SELECT case_id, compound, method, round(graph_score, 6)::DOUBLE AS graph_score, round(combined, 6)::DOUBLE AS combined FROM gs")
def heuristic_graph_scores(spark, base):
    scratch = Scratch(spark, "scores")
    return _scored(scratch, base, *_prepared(scratch, base)).select("case_id", "compound", "method", F.round("graph_score", 6).alias("graph_score"), F.round("combined", 6).alias("combined"))


@query(_SCORED + " SELECT case_id, compound, method, round(combined, 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(combined, 9) DESC, compound, method) AS place FROM gs WHERE combined > 0.5 OR graph_score > 0.3) WHERE place <= 3")
def rule_resolver(spark, base):
    """The fallback without a language model: the best three candidates above the bars."""
    scratch = Scratch(spark, "resolver")
    return C.resolve_by_rules(_scored(scratch, base, *_prepared(scratch, base))).select("case_id", "compound", "method", F.round("combined", 6).alias("confidence"))


@query(_SCORED + """, ch AS (SELECT case_id, compound, parts FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(combined, 9) DESC, compound, method) AS place FROM gs WHERE combined > 0.5 OR graph_score > 0.3) WHERE place <= 3),
go AS (SELECT DISTINCT case_id, unnest(parts) AS t FROM ch) SELECT case_id, t, false AS replaced FROM ce WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.case_id = ce.case_id AND go.t = ce.t) UNION SELECT case_id, compound, true FROM ch""")
def replaced_entities(spark, base):
    """Entities of each case with the chosen compounds in place of their parts."""
    scratch = Scratch(spark, "replaced")
    texts, entities = _prepared(scratch, base)
    return C.replace_by_compounds(entities, scratch.cut(C.resolve_by_rules(_scored(scratch, base, texts, entities)), "chosen"))


@query()
def reranked_compounds(spark, base):
    """Candidates by likeness and by the standing of their vertices in the merged graph (betweenness from a hash sample of sources), with bonuses."""
    from ..operators import graph as G
    from .graphs import patient_edges

    scratch = Scratch(spark, "rerank")
    m = scratch.cut(G.mega_graph(patient_edges(spark, base), "relationship"), "mega")
    some = G.vertices_of(m, []).where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0)
    rank = G.pagerank(m, scratch, weight="weight").select("id", F.col("rank").alias("pagerank"))
    metrics = rank.join(G.degree_centrality(m, []).withColumnRenamed("centrality", "degree"), "id").join(G.betweenness(m, scratch, sources=some), "id")
    texts, entities = _prepared(scratch, base)
    scored = C.rerank(C.metric_scores(_similar(scratch, base, texts, entities), scratch.cut(metrics, "metrics")), texts)
    return scored.select("case_id", "compound", "method", F.round("graph", 9).alias("graph"), F.round("final", 9).alias("final"))


@query()
def clinical_merge(spark, base):
    """What becomes of each case's entities: compounds, matrix merges, clinical pairs, and the rest as it is."""
    scratch = Scratch(spark, "merge")
    merged = C.merge_by_matrix(_matrix(spark, base, 0.7), scratch, 0.7)
    texts, entities = _prepared(scratch, base)
    return C.merge_cascade(texts, entities, _candidates(scratch, base, texts, entities), merged)


_WORDS_IN = "list_filter(list_distinct(string_split({}, ' ')), lambda w: w <> '')"
_LIKE = f"(len(list_intersect({_WORDS_IN.format('t')}, {_WORDS_IN.format('term')})) / sqrt(len({_WORDS_IN.format('t')})::DOUBLE * len({_WORDS_IN.format('term')})))"


@query(f"""{_CASES}, d AS (SELECT DISTINCT t FROM ce), l AS (SELECT t, term, CASE WHEN t = term THEN 1.0 WHEN contains(term, t) OR contains(t, term) THEN 0.8 ELSE 0.6 END::DOUBLE AS link, {_LIKE} AS retrieval
  FROM d JOIN terms ON contains(term, t) OR contains(t, term) OR len(list_filter(string_split(t, ' '), lambda w: length(w) > 2 AND contains(term, w))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(link * retrieval, 9) DESC, length(term), term DESC) AS rn FROM l) SELECT t, term AS concept, link, round(retrieval, 6) AS retrieval, round(link * retrieval, 6) AS score FROM r WHERE rn = 1""")
def linked_entities(spark, base):
    """The concept each entity is linked to, by link score (1, 0.8, 0.6) times the retriever's."""
    out = C.linked_entities(_entities(spark, base), terms(spark, base))
    return out.select("t", "concept", "link", F.round("retrieval", 6).alias("retrieval"), F.round("score", 6).alias("score"))


@query(f"""WITH {_TERMS}, {ENTITIES}, n AS (SELECT case_id, text AS t, lead(text) OVER w AS t2, lead(text, 2) OVER w AS t3 FROM (SELECT DISTINCT case_id, clean(text) AS text, score FROM entity_rows WHERE length(clean(text)) > 0 AND score IS NOT NULL AND case_id IS NOT NULL) WINDOW w AS (PARTITION BY case_id ORDER BY score, text)),
k AS (SELECT term AS c FROM terms UNION SELECT replace(term, ' of the ', ' ') FROM terms), c AS (SELECT case_id, t || ' ' || t2 AS compound, 0.9::DOUBLE AS score FROM n WHERE t2 IS NOT NULL UNION SELECT case_id, t || ' ' || t2 || ' ' || t3, 0.95 FROM n WHERE t3 IS NOT NULL)
SELECT case_id, compound, score FROM c WHERE compound IN (SELECT c FROM k)""")
def adjacent_compounds(spark, base):
    """Neighbouring entities, by score, that together are a known term (with or without "of the"): pairs at 0.9, triples at 0.95."""
    e = case_entities(spark, base).where("score IS NOT NULL").select("case_id", F.col("t").alias("text"), "score").distinct().withColumn("order", F.struct("score", "text"))
    known = terms(spark, base).select(F.explode(F.array("term", F.replace("term", F.lit(" of the "), F.lit(" ")))).alias("term"))
    return O.adjacent_compounds(e, ["case_id"], "order", known)
