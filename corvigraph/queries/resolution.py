"""Entity resolution over mentions, names and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import resolution as E
from ..plans.scratch import Scratch
from ..registry import query
from ..sources.tables import table

_TERMS = "terms AS (SELECT DISTINCT x AS term FROM (SELECT clean(source_entity_name) AS x FROM clinical_relationships UNION ALL SELECT clean(target_entity_name) FROM clinical_relationships) WHERE length(x) > 0)"


def terms(spark, base):
    return E.vocabulary(table(spark, base, "clinical_relationships"), ["source_entity_name", "target_entity_name"])


@query(f"WITH {_TERMS} SELECT term FROM terms")
def vocabulary(spark, base):
    return terms(spark, base)


_NEAREST = """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM s)"""


def _asked(spark, base):
    """Every vector whose id is divisible by 50: the queries of the searches."""
    return table(spark, base, "embeddings").where("vec_id % 50 = 0")


def _nearest(spark, base):
    return E.nearest_neighbours(table(spark, base, "embeddings"), "vec_id", "embedding", queries=_asked(spark, base))


@query(f"{_NEAREST} SELECT a, b, round(c, 5) AS cosine FROM r WHERE rn <= 5")
def knn_pairs(spark, base):
    """The five nearest of each query vector among all vectors, exact."""
    return _nearest(spark, base).withColumn("cosine", F.round("cosine", 5))


@query()
def knn_index(spark, base):
    """The same by an inverted-file index; the tests hold its recall against the exact search."""
    return E.indexed_neighbours(table(spark, base, "embeddings"), _asked(spark, base), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 5))


@query(f"{_NEAREST} SELECT a, b, round(c, 5) AS cosine FROM r WHERE rn <= 5 AND a < b AND c > 0.7")
def knn_candidate_pairs(spark, base):
    """Candidates of one entity: distance below 0.3. The invented vectors of the test tables hold none so near."""
    return E.candidate_pairs(_nearest(spark, base)).withColumn("cosine", F.round("cosine", 5))


@query(f"{_NEAREST} SELECT a, b, round(c, 5) AS cosine FROM r WHERE rn <= 5 AND a < b AND c > 0.3")
def knn_candidate_pairs_far(spark, base):
    """The same with a bar that the test vectors reach."""
    return E.candidate_pairs(_nearest(spark, base), 0.3).withColumn("cosine", F.round("cosine", 5))


_WORDS = _TERMS + """, h AS (SELECT a.term AS a, b.term AS b FROM terms a JOIN terms b ON a.term < b.term AND (contains(b.term, a.term) OR contains(a.term, b.term)
OR (abs(length(a.term) - length(b.term)) <= 5 AND len(list_intersect(list_filter(string_split(a.term, ' '), lambda w: w <> ''), string_split(b.term, ' '))) > 0)))"""


@query(f"WITH {_WORDS} SELECT a, b FROM h")
def heuristic_pairs(spark, base):
    return E.heuristic_pairs(terms(spark, base), whole_words=False)


def _matches(spark, base):
    return E.verified(E.heuristic_pairs(terms(spark, base), whole_words=False), 0.8)


_MATCH = rf"{_WORDS}, m AS MATERIALIZED (SELECT a, b FROM h WHERE 1 - levenshtein(regexp_replace(a, '[^\x00-\x7F]', '?', 'g'), regexp_replace(b, '[^\x00-\x7F]', '?', 'g'))::DOUBLE / greatest(length(a), length(b)) >= 0.8)"


@query(f"WITH {_MATCH} SELECT a, b FROM m")
def verified_pairs(spark, base):
    return _matches(spark, base).select("a", "b")


_CANON = f"WITH RECURSIVE {_MATCH}, both_ways AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, z.b FROM reach r JOIN both_ways z ON r.y = z.a), part AS (SELECT x AS term, least(x, min(y)) AS part FROM reach GROUP BY x), every AS (SELECT t.term, coalesce(part, t.term) AS part FROM terms t LEFT JOIN part p ON p.term = t.term), c AS (SELECT term, first_value(term) OVER (PARTITION BY part ORDER BY length(term), term) AS canonical FROM every)"


@query(_CANON + " SELECT term, canonical FROM c")
def canonical_mapping(spark, base):
    return E.resolve(terms(spark, base), _matches(spark, base), Scratch(spark, "resolve"))


@query(_CANON + " SELECT count(DISTINCT term) AS before, count(DISTINCT canonical) AS after, count(DISTINCT term) - count(DISTINCT canonical) AS merged, round(100.0 * (count(DISTINCT term) - count(DISTINCT canonical)) / count(DISTINCT term), 1)::DOUBLE AS pct FROM c")
def resolution_stats(spark, base):
    return E.reduction(canonical_mapping(spark, base))


@query(f"WITH {_TERMS}, k AS (SELECT DISTINCT clean(x) AS term FROM (SELECT e.text AS x FROM (SELECT unnest(entities) AS e FROM rag_entities))) SELECT count(*) AS terms, count(k.term) AS covered, round(count(k.term)::DOUBLE / count(*), 6) AS share FROM terms LEFT JOIN k USING (term)")
def vocabulary_coverage(spark, base):
    known = table(spark, base, "rag_entities").select(F.explode("entities.text").alias("x")).select(clean(F.col("x")).alias("term"))
    return E.coverage(terms(spark, base), known).withColumn("share", F.round("share", 6))


@query("WITH s AS (SELECT DISTINCT clean(source_entity_name) AS k, clean(relationship_type) || '>' || clean(target_entity_name) AS i FROM clinical_relationships WHERE target_entity_name IS NOT NULL AND source_entity_name IS NOT NULL AND relationship_type IS NOT NULL), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 6)::DOUBLE AS jaccard, round(c / least(x.n, y.n), 6)::DOUBLE AS overlap, round(c / sqrt(x.n * y.n), 6)::DOUBLE AS cosine FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b")
def node_similarity(spark, base):
    r = table(spark, base, "clinical_relationships").where("source_entity_name IS NOT NULL AND target_entity_name IS NOT NULL AND relationship_type IS NOT NULL")
    s = r.select(clean(F.col("source_entity_name")).alias("k"), F.concat(clean(F.col("relationship_type")), F.lit(">"), clean(F.col("target_entity_name"))).alias("i"))
    return E.set_likeness(s, "k", "i").select("a", "b", *[F.round(c, 6).alias(c) for c in ("jaccard", "overlap", "cosine")])


@query()
def projected_vertices(spark, base):
    """Vertices by fast random projection of the merged graph."""
    from .graphs import patient_edges

    return E.random_projection(patient_edges(spark, base).select("src", "dst"), Scratch(spark, "projection"))
