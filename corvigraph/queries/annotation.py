"""Rule-based annotation of the clinical texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import clean
from ..operators import annotation as A
from ..operators import relational as R
from ..registry import query
from ..sources.tables import table
from .relational import ENTITIES, entity_rows


def _like(words: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"""WITH p AS (SELECT rel_id, lower(evidence) AS t, strpos(lower(evidence), lower(target_entity_name)) - 1 AS pos FROM clinical_relationships WHERE evidence IS NOT NULL AND target_entity_name IS NOT NULL),
w AS (SELECT rel_id, pos, substring(t, greatest(pos - 100, 0) + 1, least(pos, 100)) AS w FROM p)
SELECT rel_id, CASE WHEN pos > 0 AND regexp_matches(w, 'no |without |absence of|ruled out|normal |unremarkable') THEN 'absent' WHEN pos > 0 AND regexp_matches(w, 'possible|suspected|likely|questionable|may represent|consider') THEN 'possible' WHEN pos > 0 AND regexp_matches(w, 'previous|prior|history of|old|chronic') THEN 'past' ELSE 'present' END AS assertion FROM w""")
def assertion_rules(spark, base):
    r = table(spark, base, "clinical_relationships").where("evidence IS NOT NULL AND target_entity_name IS NOT NULL")
    return r.select("rel_id", T.assertion(F.col("evidence"), F.col("target_entity_name")).alias("assertion"))


_CRITICAL = (
    "pneumothorax|pleural effusion|pulmonary nodule|lung mass|pulmonary metastases|congestive heart failure|chf|cardiogenic edema|pulmonary thromboembolism|pte|pericardial effusion|heart-based mass|fungal pneumonia|aspiration pneumonia"
    "|foreign body|gastric dilatation-volvulus|gdv|hemoabdomen|free abdominal fluid|urinary bladder rupture|intestinal obstruction|mesenteric volvulus|splenic torsion|renal lymphoma|pancreatic mass|pancreatitis"
    "|fracture|aggressive bone lesion|osteosarcoma|bone lysis|joint luxation|hip luxation|vertebral luxation|disk extrusion|ischemic myelopathy|thalamic astrocytoma"
)


@query(f"WITH {ENTITIES} SELECT case_id, text, coalesce(regexp_matches(lower(text), '{_CRITICAL}'), false) AS critical FROM entity_rows")
def critical_flag(spark, base):
    return entity_rows(spark, base).select("case_id", "text", T.is_critical(F.col("text")).alias("critical"))


@query("""WITH t AS (SELECT report_id, 'History: ' || coalesce(history, '') || chr(10) || 'Findings: ' || coalesce(findings, '') || chr(10) || 'Conclusions: ' || coalesce(conclusions, '') || chr(10) || 'Recommendations: ' || coalesce(recommendations, '') AS text FROM reports_lean),
p AS (SELECT report_id, lower(text) AS low, strpos(lower(text), 'measur') - 1 AS pos FROM t)
SELECT report_id, pos::INT AS pos, arg_max(name, place) AS section FROM (
  SELECT report_id, pos, name, CASE WHEN strpos(substring(low, 1, pos), h) > 0 THEN length(substring(low, 1, pos)) - length(string_split(substring(low, 1, pos), h)[-1]) ELSE 0 END AS place
  FROM p, (VALUES ('history', 'history:'), ('findings', 'findings:'), ('conclusions', 'conclusions:'), ('recommendations', 'recommendations:')) s(name, h) WHERE pos > 0) GROUP BY report_id, pos""")
def section_rules(spark, base):
    """Section, by the nearest header before it, of the first measurement of each assembled report."""
    parts = {n.capitalize(): F.col(n) for n in ("history", "findings", "conclusions", "recommendations")}
    t = table(spark, base, "reports_lean").select("report_id", T.assemble(parts, 1 << 30).alias("text")).withColumn("pos", T.find(F.lower("text"), F.lit("measur"))).where("pos > 0")
    return t.select("report_id", "pos", T.section_of(F.col("text"), F.col("pos")).alias("section"))


@query("SELECT report_id, section, length(text)::INT AS chars FROM (SELECT report_id, unnest([{'section': 'history', 'text': history}, {'section': 'findings', 'text': findings}, {'section': 'conclusions', 'text': conclusions}, {'section': 'recommendations', 'text': recommendations}], recursive := true) FROM reports_lean) WHERE length(trim(text, ' ')) > 0")
def section_unpivot(spark, base):
    return A.by_section(table(spark, base, "reports_lean"), ["report_id"], ["history", "findings", "conclusions", "recommendations"]).select("report_id", "section", F.length("text").alias("chars"))


_LEXICON = {"cardiomegaly": "FINDING", "ileus": "FINDING", "osteophytosis": "FINDING", "pleural effusion": "FINDING", "fracture": "FINDING", "left hip": "ANATOMY", "right hip": "ANATOMY", "thoracic spine": "ANATOMY", "left stifle": "ANATOMY", "heart base": "ANATOMY"}


def _annotated(spark, base):
    r = table(spark, base, "reports_lean").select("report_id", "findings")
    out = A.annotate(r, "findings", A.dictionary_annotator(_LEXICON))
    return out.select("report_id", F.explode("entities").alias("e")).select("report_id", "e.*")


_SPANS = r"""WITH t(term, label) AS (VALUES ('cardiomegaly', 'FINDING'), ('ileus', 'FINDING'), ('osteophytosis', 'FINDING'), ('pleural effusion', 'FINDING'), ('fracture', 'FINDING'), ('left hip', 'ANATOMY'), ('right hip', 'ANATOMY'), ('thoracic spine', 'ANATOMY'), ('left stifle', 'ANATOMY'), ('heart base', 'ANATOMY')),
p AS (SELECT report_id, findings, term, label, string_split(lower(findings), term) AS p FROM reports_lean, t WHERE contains(lower(findings), term)),
s AS (SELECT report_id, findings, term, label, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term)))::INT AS start FROM p),
spans AS (SELECT report_id, substring(findings, start + 1, length(term)) AS text, label, start, start + length(term)::INT AS "end" FROM s
  WHERE NOT regexp_matches(substring(findings, start, 1), '^[\p{L}\p{N}_]$') AND NOT regexp_matches(substring(findings, start + length(term)::INT + 1, 1), '^[\p{L}\p{N}_]$'))"""


@query(_SPANS + " SELECT report_id, text, label, start, \"end\", 1.0::DOUBLE AS score FROM spans")
def dictionary_entities(spark, base):
    """Spans of the dictionary annotator: the stand-in for an external model."""
    return _annotated(spark, base)


@query(r"SELECT report_id, len(regexp_extract_all(coalesce(findings, ''), '(?i)\b(?:pleural effusion|thoracic spine|osteophytosis|cardiomegaly|left stifle|heart base|right hip|fracture|left hip|ileus)\b'))::INT AS num_entities FROM reports_lean")
def entity_rollup(spark, base):
    """Entities per report as an array; reports without any keep an empty one."""
    return A.roll_up(table(spark, base, "reports_lean"), _annotated(spark, base).select("report_id", "start", "text", "label"), "report_id").select("report_id", "num_entities")


@query()
def span_align(spark, base):
    """Character spans as token spans."""
    r = table(spark, base, "reports_lean").select("report_id", "findings").where("findings IS NOT NULL")
    return A.align_entities(A.annotate(r, "findings", A.dictionary_annotator(_LEXICON)), ["report_id"], "findings")


@query(f"WITH {ENTITIES}, e AS (SELECT *, row_number() OVER (PARTITION BY case_id, clean(text) ORDER BY score, text, section NULLS FIRST, category NULLS FIRST) AS rn, max(score) OVER (PARTITION BY case_id, clean(text)) AS best FROM entity_rows WHERE text IS NOT NULL) SELECT case_id, clean(text) AS norm, best AS score FROM e WHERE rn = 1")
def chunk_merge(spark, base):
    e = entity_rows(spark, base).where("text IS NOT NULL").withColumn("position", F.struct("score", "section", "category")).drop("assertion", "is_critical")
    return A.merge_chunk_entities(e, ["case_id"]).select("case_id", "norm", "score")


@query("WITH e AS (SELECT DISTINCT rel_id, unnest([clean(source_entity_name), clean(target_entity_name)]) AS x FROM clinical_relationships) SELECT a.rel_id, a.x AS head, b.x AS tail FROM e a JOIN e b ON a.rel_id = b.rel_id AND a.x < b.x")
def cooccurrence_relations(spark, base):
    r = table(spark, base, "clinical_relationships").select("rel_id", F.explode(F.array("source_entity_name", "target_entity_name")).alias("text"))
    return A.co_occurrence_relations(r, ["rel_id"]).select("rel_id", "head", "tail")


@query()
def chunk_statistics(spark, base):
    """Chunks of up to 48 words with overlap up to 8: how many, and how many end on a sentence."""
    c = A.chunk_sentences(table(spark, base, "reports_lean").where("findings IS NOT NULL"), ["report_id"], "findings", 48, 8)
    per = c.groupBy("report_id").agg(F.count(F.lit(1)).alias("chunks"))
    s = per.agg(F.sum("chunks").alias("chunks"), F.round(F.avg("chunks"), 4).alias("per_text"), F.round(F.avg((F.col("chunks") > 1).cast("int")), 4).alias("multi"))
    return s.crossJoin(c.agg(F.round(F.avg(F.col("ends_at_sentence").cast("int")), 4).alias("at_sentence")))


@query("WITH k AS (SELECT DISTINCT relationship_type AS raw, replace(regexp_replace(clean(relationship_type), ' +', ' ', 'g'), '_', ' ') AS kind FROM clinical_relationships WHERE relationship_type IS NOT NULL) SELECT coalesce(k.kind, 'unknown') AS kind, count(*) AS relations FROM clinical_relationships c LEFT JOIN k ON k.raw = c.relationship_type GROUP BY 1")
def type_normalisation(spark, base):
    """Each distinct raw type is normalised once and mapped back."""
    r = table(spark, base, "clinical_relationships").select("relationship_type")
    kinds = r.where("relationship_type IS NOT NULL").distinct().withColumn("kind", F.replace(F.regexp_replace(clean(F.col("relationship_type")), " +", " "), F.lit("_"), F.lit(" ")))
    return R.lookup(r, "relationship_type", kinds, "relationship_type", "kind", "kind", F.lit("unknown")).groupBy("kind").agg(F.count(F.lit(1)).alias("relations"))
