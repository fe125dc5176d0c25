"""Hierarchies, rule relations, matrices and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import ontology as O  # noqa: E741
from ..registry import query
from ..sources.tables import table
from .relational import ENTITIES, entity_rows
from .resolution import _TERMS, terms


@query(f"""WITH {_TERMS}, fixed(parent, child) AS (VALUES ('vaccine', 'vaccine vaccination'), ('immunization', 'immunization vaccination'), ('drug', 'drug medication'), ('medicine', 'medicine medication'), ('therapeutic', 'therapeutic medication'),
('surgical', 'surgical surgery'), ('operation', 'operation surgery'), ('procedure', 'procedure surgery'), ('treatment', 'treatment therapy'), ('therapeutic', 'therapeutic therapy'), ('diagnostic', 'diagnostic diagnosis'), ('finding', 'finding diagnosis'), ('treatment', 'treatment management'), ('care', 'care management')),
s AS (SELECT a.term AS parent, b.term AS child, 'substring' AS source FROM terms a JOIN terms b ON a.term <> b.term AND contains(b.term, a.term)),
i AS (SELECT clean(target_entity_name) AS o, clean(source_entity_name) AS s, 'is_a' FROM clinical_relationships WHERE clean(relationship_type) = 'part of')
SELECT DISTINCT * FROM (SELECT * FROM s UNION ALL SELECT * FROM i WHERE length(o) >= 3 AND length(s) >= 3 AND o <> s AND NOT regexp_matches(o, '^[0-9]+$') AND NOT regexp_matches(s, '^[0-9]+$') UNION ALL SELECT parent, child, 'fixed' FROM fixed)""")
def hierarchy_pairs(spark, base):
    """Terms in terms, "part of" as the tables' own hierarchy, and the fixed compounds."""
    r = table(spark, base, "clinical_relationships").where(clean(F.col("relationship_type")) == "part of").select(clean(F.col("target_entity_name")).alias("object"), clean(F.col("source_entity_name")).alias("subject"))
    return O.hierarchy_pairs(terms(spark, base), r, O.compound_pairs(spark))


@query(f"WITH {ENTITIES}, e AS (SELECT case_id, clean(text) AS t, max(score) AS w FROM entity_rows WHERE text IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2) SELECT a.case_id, a.t AS i, b.t AS j, round(a.w * b.w, 8) AS weight FROM e a JOIN e b ON a.case_id = b.case_id AND a.t < b.t")
def cooccurrence_matrix(spark, base):
    e = entity_rows(spark, base).where("text IS NOT NULL AND score IS NOT NULL").select("case_id", clean(F.col("text")).alias("t"), "score")
    return O.cooccurrence_matrix(e, "case_id", "t", "score").withColumn("weight", F.round("weight", 8))


@query("SELECT rel_id, CASE WHEN p > 0 AND q > 0 THEN round(greatest(0.0, 1 - abs(p - q)::DOUBLE / length(evidence)), 6) ELSE 0 END::DOUBLE AS strength FROM (SELECT rel_id, evidence, strpos(lower(evidence), clean(source_entity_name)) AS p, strpos(lower(evidence), clean(target_entity_name)) AS q FROM clinical_relationships WHERE length(evidence) > 0)")
def global_cooccurrence(spark, base):
    r = table(spark, base, "clinical_relationships").where("length(evidence) > 0")
    return r.select("rel_id", F.round(O.proximity(F.lower("evidence"), clean(F.col("source_entity_name")), clean(F.col("target_entity_name"))), 6).alias("strength"))


@query("""WITH a AS (SELECT clean(source_entity_name) AS head, clean(target_entity_name) AS tail, clean(relationship_type) AS type, 0.5::DOUBLE AS score, rel_id FROM clinical_relationships WHERE relationship_type IS NOT NULL AND source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL),
o AS (SELECT DISTINCT head, tail, type, score FROM a WHERE type = 'causes'), t AS (SELECT DISTINCT head, tail, type, score FROM a WHERE type <> 'causes'), k AS (SELECT head, tail, list(type) AS types FROM o GROUP BY 1, 2)
SELECT head, tail, type, round(score * 1.1, 6) AS score, 'ontology' AS origin FROM o UNION ALL
SELECT t.head, t.tail, t.type, round(CASE WHEN types IS NOT NULL AND NOT list_contains(types, t.type) THEN score * 0.7 ELSE score END, 6), 'text' FROM t LEFT JOIN k ON t.head = k.head AND t.tail = k.tail""")
def relation_merge(spark, base):
    r = table(spark, base, "clinical_relationships").where("relationship_type IS NOT NULL AND source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL")
    r = r.select(clean(F.col("source_entity_name")).alias("head"), clean(F.col("target_entity_name")).alias("tail"), clean(F.col("relationship_type")).alias("type"), F.lit(0.5).alias("score")).distinct()
    return O.merge_relation_sources(r.where("type = 'causes'"), r.where("type != 'causes'")).withColumn("score", F.round("score", 6))


_DOC_WORDS = "d AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL), q AS (SELECT subject AS query_id, list_filter(string_split(lower(description), ' '), lambda w: w <> '') AS words FROM subject_areas)"
_BM25 = f"""WITH {_DOC_WORDS}, p AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS word FROM d) GROUP BY ALL), s AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
qw AS (SELECT DISTINCT query_id, unnest(words) AS word FROM q),
b AS MATERIALIZED (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM qw JOIN f USING (word) JOIN p USING (word), s GROUP BY ALL)"""


def _bm25(spark, base):
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: w != "")
    docs = table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", words("text").alias("words"))
    asked = table(spark, base, "subject_areas").select(F.col("subject").alias("query_id"), words("description").alias("words"))
    return O.bm25(docs, asked)


@query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score FROM b")
def bm25(spark, base):
    return _bm25(spark, base).withColumn("score", F.round("score", 6))


@query(_BM25 + """, du AS (SELECT doc_id, list_distinct(words) AS w FROM d), qu AS (SELECT query_id, list_distinct(words) AS w FROM q),
h AS (SELECT b.query_id, b.doc_id, score, len(list_intersect(du.w, qu.w)) / sqrt(len(du.w)::DOUBLE * len(qu.w)) AS dense FROM b JOIN du ON du.doc_id = b.doc_id JOIN qu ON qu.query_id = b.query_id),
m AS (SELECT *, 0.7 * (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w + 1e-8) + 0.3 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8) AS hybrid FROM h WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, doc_id) AS rn FROM m) SELECT query_id, doc_id, round(hybrid, 6) AS hybrid FROM r WHERE rn <= 3 AND hybrid > 0.1""")
def bm25_hybrid(spark, base):
    """Top three by 0.7 of a vector and 0.3 of the term score, both scaled; the vectors are binary word vectors and their likeness the cosine, in place of an external encoder."""
    from ..operators.relational import top_per_group

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    docs = table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", words("text").alias("w"))
    asked = table(spark, base, "subject_areas").select(F.col("subject").alias("query_id"), words("description").alias("q"))
    sizes = docs.select("doc_id", F.size("w").alias("nd"), F.explode("w").alias("word"))
    query_words = asked.select("query_id", F.size("q").alias("nq"), F.explode("q").alias("word"))
    dense = sizes.join(query_words, "word").groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.sqrt(F.first("nd").cast("double") * F.first("nq"))).alias("dense"))
    h = O.hybrid(_bm25(spark, base).join(dense, ["query_id", "doc_id"]), ["query_id"], "dense", "score")
    return top_per_group(h, ["query_id"], [F.desc(F.round("hybrid", 9)), F.col("doc_id")], 3).where("hybrid > 0.1").select("query_id", "doc_id", F.round("hybrid", 6).alias("hybrid"))


@query(f"WITH {_TERMS}, {ENTITIES}, m AS (SELECT DISTINCT clean(text) AS mention FROM entity_rows WHERE length(clean(text)) > 0), x AS (SELECT m.mention, arg_min(t.term, struct_pack(l := length(t.term), t := t.term)) AS near FROM m JOIN terms t ON (contains(t.term, m.mention) OR contains(m.mention, t.term)) WHERE m.mention NOT IN (SELECT term FROM terms) GROUP BY 1) SELECT m.mention, CASE WHEN t.term IS NOT NULL THEN m.mention ELSE near END AS concept, CASE WHEN t.term IS NOT NULL THEN 1.0 WHEN near IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM m LEFT JOIN terms t ON t.term = m.mention LEFT JOIN x ON x.mention = m.mention")
def concept_lookup(spark, base):
    m = entity_rows(spark, base).select(clean(F.col("text")).alias("mention")).where("length(mention) > 0")
    return O.concept_lookup(m, terms(spark, base))


@query()
def compound_selection(spark, base):
    """Multi-word terms with two or more words among a case's entities, taken greedily without overlap."""
    e = entity_rows(spark, base).where("text IS NOT NULL").select("case_id", clean(F.col("text")).alias("text"))
    return O.select_compounds(terms(spark, base), e, "case_id")


@query(f"WITH {ENTITIES}, e AS (SELECT case_id, string_split(clean(text), ' ')[-1] AS concept, clean(text) AS text FROM entity_rows WHERE text IS NOT NULL), w AS (SELECT case_id, concept, unnest(string_split(text, ' ')) AS word FROM e) SELECT case_id, concept, array_to_string(list_sort(list(DISTINCT word)), ' ') AS merged FROM w GROUP BY 1, 2")
def concept_merge(spark, base):
    e = entity_rows(spark, base).where("text IS NOT NULL").select("case_id", clean(F.col("text")).alias("text")).withColumn("concept", F.element_at(F.split("text", " "), -1))
    return O.merge_by_concept(e, "case_id").select("case_id", "concept", "merged")
