"""Scalar functions and predicates over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import table
from .relational import ENTITIES, entity_rows


@query("SELECT report_id, substring(concat('History: ', coalesce(history, ''), chr(10) || 'Findings: ', coalesce(findings, ''), chr(10) || 'Conclusions: ', coalesce(conclusions, ''), chr(10) || 'Recommendations: ', coalesce(recommendations, '')), 1, 4000) AS text FROM reports_lean WHERE length(findings) > 50")
def doc_assembly(spark, base):
    parts = {n.capitalize(): F.col(n) for n in ("history", "findings", "conclusions", "recommendations")}
    return table(spark, base, "reports_lean").where(F.length("findings") > 50).select("report_id", T.assemble(parts).alias("text"))


@query("SELECT report_id, length(findings) AS chars, CASE WHEN length(trim(findings)) >= 5 THEN true ELSE false END AS long_enough, CASE WHEN length(findings) > 40 THEN substring(findings, 1, 40) || '...' ELSE findings END AS shown FROM reports_lean WHERE findings IS NOT NULL OR conclusions IS NOT NULL")
def text_guards(spark, base):
    r = table(spark, base, "reports_lean").where(F.col("findings").isNotNull() | F.col("conclusions").isNotNull())
    return r.select("report_id", F.length("findings").alias("chars"), F.coalesce(F.length(F.trim("findings")) >= 5, F.lit(False)).alias("long_enough"), T.truncate(F.col("findings"), 40).alias("shown"))


@query("SELECT rel_id, CASE WHEN evidence IS NULL THEN NULL ELSE strpos(lower(evidence), lower(source_entity_name)) - 1 END AS position FROM clinical_relationships WHERE source_entity_name IS NOT NULL")
def find_offsets(spark, base):
    return table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL").select("rel_id", T.find(F.lower("evidence"), F.lower("source_entity_name")).alias("position"))


@query("SELECT doc_id, CAST(len(string_split(regexp_replace(trim(text), ' +', ' ', 'g'), ' ')) AS INT) AS blanks_words, replace(substring(text, 1, 30), ' ', '_') AS tag, regexp_matches(text, '^[A-Za-z]') AS starts_with_letter, round(least(1.0, n_chars / 1000.0), 3)::DOUBLE AS scaled FROM documents WHERE text IS NOT NULL")
def scalar_functions(spark, base):
    d = table(spark, base, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(F.split(F.regexp_replace(F.trim("text"), " +", " "), " ")).alias("blanks_words"), F.replace(F.substring("text", 1, 30), F.lit(" "), F.lit("_")).alias("tag"), F.col("text").rlike("^[A-Za-z]").alias("starts_with_letter"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 1000.0), 3).alias("scaled"))


@query(f"WITH {ENTITIES} SELECT assertion || ' definitely ' || CASE WHEN is_critical THEN 'present' ELSE 'absent' END AS label, assertion AS base, CASE WHEN is_critical THEN 'present' ELSE 'absent' END AS polarity, count(*) AS n FROM entity_rows WHERE assertion IS NOT NULL GROUP BY ALL")
def parse_label(spark, base):
    e = entity_rows(spark, base).where("assertion IS NOT NULL").select(F.concat("assertion", F.lit(" definitely "), F.when(F.col("is_critical"), "present").otherwise("absent")).alias("label"))
    b, p = T.parse_label(F.col("label"))
    return e.select("label", b.alias("base"), p.alias("polarity")).groupBy("label", "base", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTITIES} SELECT case_id, array_to_string(list_sort(list(DISTINCT clean(text))), ' + ') AS joined FROM entity_rows WHERE text IS NOT NULL GROUP BY case_id")
def sorted_join(spark, base):
    return entity_rows(spark, base).where("text IS NOT NULL").groupBy("case_id").agg(F.collect_list(T.clean(F.col("text"))).alias("x")).select("case_id", T.sorted_distinct_join(F.col("x"), " + ").alias("joined"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 5) AS norm_a FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_functions(spark, base):
    e = table(spark, base, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(nxt, "a").select("a", "b", F.round(T.cosine(F.col("x"), F.col("y")), 5).alias("cosine"), F.round(T.norm(F.col("x")), 5).alias("norm_a"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo + 1e-8), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def minmax_scale(spark, base):
    p = table(spark, base, "part")
    edge = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.crossJoin(F.broadcast(edge)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8), 6).alias("scaled"))


@query(r"SELECT rel_id, levenshtein(regexp_replace(clean(source_entity_name), '[^\x00-\x7F]', '?', 'g'), regexp_replace(clean(target_entity_name), '[^\x00-\x7F]', '?', 'g')) AS edits FROM clinical_relationships WHERE source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL")
def string_similarity_score(spark, base):
    r = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL").select("rel_id", T.clean(F.col("source_entity_name")).alias("a"), T.clean(F.col("target_entity_name")).alias("b"))
    ascii_only = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return r.select("rel_id", F.levenshtein(ascii_only("a"), ascii_only("b")).cast("long").alias("edits"))


@query()
def string_distances(spark, base):
    """Dice, Jaro-Winkler, Hamming, phonetic code and edit likeness of the two names of each relation."""
    r = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL").select("rel_id", T.clean(F.col("source_entity_name")).alias("a"), T.clean(F.col("target_entity_name")).alias("b"))
    return r.select("rel_id", F.round(T.dice(F.col("a"), F.col("b")), 6).alias("dice"), T.hamming(F.col("a"), F.col("b")).alias("hamming"), F.soundex("a").alias("sound"), F.round(T.likeness(F.col("a"), F.col("b")), 6).alias("likeness"), F.round(T.jaro_winkler_col(F.col("a"), F.col("b")), 6).alias("jaro_winkler"))


@query("SELECT record_id, e.key AS mention, e.value.name AS name, e.value.type AS type FROM (SELECT record_id, unnest(map_entries(entity_map)) AS e FROM resolved_entities)")
def map_entries(spark, base):
    return table(spark, base, "resolved_entities").select("record_id", F.explode("entity_map").alias("mention", "v")).select("record_id", "mention", "v.name", "v.type")


@query("SELECT case_id, processed_at, CASE WHEN len(entities) > 0 THEN entities[1].text END AS first_text, CASE WHEN entities IS NULL THEN -1 ELSE len(entities) END AS size FROM rag_entities")
def array_access(spark, base):
    return table(spark, base, "rag_entities").select("case_id", "processed_at", F.get("entities", F.lit(0))["text"].alias("first_text"), F.coalesce(F.size("entities"), F.lit(-1)).cast("long").alias("size"))
