"""JSON documents, and tables written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import repair_json
from ..operators.relational import split_valid
from ..plans.scratch import Scratch
from ..registry import query
from ..sources import formats
from ..sources.tables import table

_J = "SELECT pims_animal_rowkey, CASE WHEN json_valid(json_sopr) THEN json_sopr::JSON END AS j FROM patient_json"


def patients(spark, base):
    """(pims_animal_rowkey, d): documents parsed after repair; null where they stay broken. Only the fields read later are parsed."""
    p = table(spark, base, "patient_json")
    return p.select("pims_animal_rowkey", F.from_json(repair_json(F.col("json_sopr")), formats.PATIENT_SCHEMA).alias("d"))


@query(f"SELECT pims_animal_rowkey, j->>'$.demographics.animal.animal_name' AS name, j->>'$.demographics.animal.species' AS species, j->>'$.demographics.practice.practice_rowkey' AS practice FROM (SELECT pims_animal_rowkey, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM ({_J}))")
def patient_json_flatten(spark, base):
    """Every document's fields as it stands; null where it is no valid document."""
    valid = F.expr("try_parse_json(json_sopr) IS NOT NULL AND ltrim(json_sopr) LIKE '{%'")
    d = table(spark, base, "patient_json").select("pims_animal_rowkey", F.when(valid, F.from_json("json_sopr", formats.PATIENT_SCHEMA)).alias("d"))
    return d.select("pims_animal_rowkey", F.col("d.demographics.animal.animal_name").alias("name"), F.col("d.demographics.animal.species").alias("species"), F.col("d.demographics.practice.practice_rowkey").alias("practice"))


_REPAIRED = r"""WITH b AS (SELECT pims_animal_rowkey, trim(regexp_replace(regexp_replace(json_sopr, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '')) AS b FROM patient_json),
c AS (SELECT pims_animal_rowkey, CASE WHEN regexp_extract(b, '(?s)(\{.*\})', 1) = '' THEN b ELSE regexp_extract(b, '(?s)(\{.*\})', 1) END AS c FROM b),
d AS (SELECT pims_animal_rowkey, regexp_replace(CASE WHEN contains(c, '"') THEN c ELSE translate(c, chr(39), '"') END, ',(\s*[}\]])', '\1', 'g') AS d FROM c),
e AS (SELECT pims_animal_rowkey, CASE WHEN json_valid(d) THEN d::JSON END AS j FROM d)"""


@query(f"""{_REPAIRED}, f AS (SELECT json_extract_string(j, '$.demographics.animal.animal_rowkey') IS NOT NULL AS ok FROM e)
SELECT 'parsed' AS route, count(*) FILTER (ok) AS documents FROM f UNION ALL SELECT 'quarantine', count(*) FILTER (NOT ok) FROM f""")
def patient_json_repaired(spark, base):
    """How many documents parse after repair, and how many stay in quarantine."""
    good, bad = split_valid(patients(spark, base), F.col("d.demographics.animal.animal_rowkey").isNotNull())
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("documents")).select(F.lit(name).alias("route"), "documents")
    return count(good, "parsed").unionByName(count(bad, "quarantine"))


@query(f"""{_REPAIRED}, v AS (SELECT pims_animal_rowkey, j, list_sort(list_transform((j->'$.visit_summaries')::JSON[], lambda x: struct_pack(a := coalesce(x->>'$.visit_start_date', 'N/A'), b := coalesce(x->>'$.visit_type', 'N/A'), c := coalesce(x->>'$.visit_summary', '')))) AS v FROM e WHERE json_type(j->'$.visit_summaries') = 'ARRAY')
SELECT pims_animal_rowkey, 'Species: ' || coalesce(j->>'$.demographics.animal.species', 'N/A') || chr(10) || coalesce(j->>'$.patient_summary.patient_summary_text', 'N/A') || chr(10) || chr(10) || array_to_string(list_transform(v, lambda x: x.a || ' | ' || x.b || ' | ' || x.c), chr(10) || chr(10)) AS document FROM v""")
def visit_documents(spark, base):
    """A text per patient: summary and visits in order of their dates, 'N/A' for what is missing."""
    p = patients(spark, base).where("d.visit_summaries IS NOT NULL")
    visits = F.array_sort(F.transform("d.visit_summaries", lambda v: F.struct(F.coalesce(v["visit_start_date"], F.lit("N/A")).alias("day"), F.coalesce(v["visit_type"], F.lit("N/A")).alias("kind"), F.coalesce(v["visit_summary"], F.lit("")).alias("text"))))
    lines = F.transform(visits, lambda v: F.concat_ws(" | ", v["day"], v["kind"], v["text"]))
    head = F.concat(F.lit("Species: "), F.coalesce("d.demographics.animal.species", F.lit("N/A")), F.lit("\n"), F.coalesce("d.patient_summary.patient_summary_text", F.lit("N/A")))
    return p.select("pims_animal_rowkey", F.concat(head, F.lit("\n\n"), F.array_join(lines, "\n\n")).alias("document"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, base):
    return table(spark, base, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT c_custkey, c_name FROM customer")
def csv_round_trip(spark, base):
    where = Scratch(spark, "csv").path("customer")
    formats.write_csv(table(spark, base, "customer").select("c_custkey", "c_name"), where)
    return formats.read_csv(spark, where, "c_custkey bigint, c_name string")


@query("SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def partitioned_round_trip(spark, base):
    where = Scratch(spark, "parts").path("orders")
    formats.write_table(table(spark, base, "orders"), where, ["o_orderstatus"])
    return spark.read.parquet(where).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT count(*) AS rows, min(report_id) AS first, max(report_id) AS last FROM reports_lean WHERE case_id >= 'CASE000000500'")
def clustered_round_trip(spark, base):
    where = Scratch(spark, "clustered").path("reports")
    formats.write_clustered(table(spark, base, "reports_lean").drop("recommendations"), where, ["case_id"], 8)
    return spark.read.parquet(where).where("case_id >= 'CASE000000500'").agg(F.count(F.lit(1)).alias("rows"), F.min("report_id").alias("first"), F.max("report_id").alias("last"))


@query("SELECT to_json({'o_orderstatus': o_orderstatus, 'orders': n})::VARCHAR AS value FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def json_summary(spark, base):
    return formats.as_json(table(spark, base, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")))
