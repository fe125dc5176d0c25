"""Sinks and sources beside Parquet tables, with explicit schemas."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATIENT_SCHEMA = """
demographics struct<animal: struct<animal_rowkey: string, animal_name: string, species: string, breed: string, status: string, birth_date: string, gender: string, age: int, vcp_patient_rowkeys: array<string>>,
  practice: struct<practice_rowkey: string, practice_name: string, pims: string, state_province: string, country: string>, owner: string>,
patient_summary struct<patient_summary_text: string>,
visit_summaries array<struct<visit_start_date: string, visit_type: string, visit_summary: string>>
"""


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites a Parquet table; columns of type void become strings, which no format can store otherwise."""
    for name, kind in df.dtypes:
        if kind == "void":
            df = df.withColumn(name, F.col(name).cast("string"))
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> None:
    """Parquet whose files hold disjoint ranges of ``by``, sorted: row groups prune on it."""
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str, limit: int = 100_000) -> None:
    """GraphML of a graph small enough for one file: refuses more than ``limit`` vertices or edges.

    Rows are streamed to the driver partition by partition, never held together.
    """
    if vertices.limit(limit + 1).count() > limit or edges.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} vertices or edges")
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<graph edgedefault="directed">\n')
        for v in vertices.select("id").toLocalIterator():
            out.write(f'<node id="{escape(str(v.id), {chr(34): "&quot;"})}"/>\n')
        for e in edges.select("src", "dst").toLocalIterator():
            out.write('<edge source="%s" target="%s"/>\n' % tuple(escape(str(x), {'"': "&quot;"}) for x in e))
        out.write("</graph>\n</graphml>\n")


def _attribute(c: str):
    """Text as the value of an XML attribute."""
    out = F.col(c).cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def write_graphml_parts(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML of a graph of any size as part files that, in the order of their names, are one document. Executors write; nothing passes through the driver."""
    spark = vertices.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph>\n</graphml>")], "step int, name string, value string")
    nodes = vertices.select(F.lit(1).alias("step"), F.col("id").cast("string").alias("name"), F.concat(F.lit('<node id="'), _attribute("id"), F.lit('"/>')).alias("value"))
    links = edges.select(F.lit(2).alias("step"), F.col("src").cast("string").alias("name"), F.concat(F.lit('<edge source="'), _attribute("src"), F.lit('" target="'), _attribute("dst"), F.lit('"/>')).alias("value"))
    ends.unionByName(nodes).unionByName(links).orderBy("step", "name", "value").select("value").write.mode("overwrite").text(path)


def write_rdf_triples(triples: DataFrame, path: str) -> None:
    """RDF/XML of triples (subject, predicate, object): a description for each subject; part files in the order of their names are one document."""
    subject, predicate, object_ = triples.columns
    line = F.concat(F.lit("<"), F.col(predicate), F.lit(' rdf:resource="'), _attribute(object_), F.lit('"/>'))
    rows = triples.select(_attribute(subject).alias("s"), line.alias("line")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("lines"))
    body = rows.select(F.lit(1).alias("step"), F.col("s"), F.concat(F.lit('<rdf:Description rdf:about="'), F.col("s"), F.lit('">'), F.col("lines"), F.lit("</rdf:Description>")).alias("value"))
    ends = triples.sparkSession.createDataFrame([(0, "", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'), (2, "", "</rdf:RDF>")], "step int, s string, value string")
    ends.unionByName(body).orderBy("step", "s").select("value").write.mode("overwrite").text(path)


def read_rdf_triples(spark: SparkSession, path: str, row_tag: str = "rdf:Description") -> DataFrame:
    """(subject, predicate, object) of resource links in an RDF/XML file, by Spark's XML source."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    out = None
    for name, kind in rows.dtypes:
        if name.startswith("_") or "_rdf:resource" not in kind:
            continue
        many = F.col(f"`{name}`") if kind.startswith("array") else F.array(f"`{name}`")
        part = rows.select(F.col("`_rdf:about`").alias("subject"), F.lit(name).alias("predicate"), F.explode(many).alias("o")).select("subject", "predicate", F.col("o").getField("_rdf:resource").alias("object"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "subject string, predicate string, object string")
