"""Graphs of the clinical relationships: one per patient, and all of them as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import graph as G
from ..operators.relational import with_share
from ..plans.scratch import Scratch
from ..registry import query
from ..sources.tables import table

REL = """rel AS (SELECT patient_rowkey AS g, rel_id, clean(source_entity_name) AS src, clean(target_entity_name) AS dst,
  coalesce(lower(replace(trim(relationship_type), '_', ' ')), 'unknown') AS relationship FROM clinical_relationships),
e AS MATERIALIZED (SELECT g, src, dst, arg_max(relationship, rel_id) AS relationship FROM rel WHERE g IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY g, src, dst)"""
VERTICES = "v AS MATERIALIZED (SELECT g, src AS id FROM e UNION SELECT g, dst FROM e)"
BOTH = "b AS MATERIALIZED (SELECT g, src, dst FROM e UNION SELECT g, dst, src FROM e)"
KEYS = ["g"]


def relations(spark, base):
    r = table(spark, base, "clinical_relationships")
    kind = F.coalesce(F.lower(F.replace(F.trim("relationship_type"), F.lit("_"), F.lit(" "))), F.lit("unknown"))
    return r.select(F.col("patient_rowkey").alias("g"), "rel_id", clean(F.col("source_entity_name")).alias("src"), clean(F.col("target_entity_name")).alias("dst"), kind.alias("relationship"))


def patient_edges(spark, base):
    return G.build_edges(relations(spark, base).where("g IS NOT NULL"), KEYS, "rel_id").select("g", "src", "dst", "relationship")


@query(f"WITH {REL} SELECT g, src, dst, relationship FROM e")
def edge_build(spark, base):
    return patient_edges(spark, base)


@query(f"WITH {REL}, {VERTICES} SELECT g, id FROM v")
def graph_vertices(spark, base):
    return G.vertices_of(patient_edges(spark, base), KEYS)


@query(f"WITH {REL}, o AS (SELECT g, src, dst, max(rel_id) AS no FROM rel WHERE g IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY g, src, dst) SELECT e.src, e.dst, count(*) AS weight, arg_min(relationship, no) AS relationship FROM e JOIN o ON o.g = e.g AND o.src = e.src AND o.dst = e.dst GROUP BY 1, 2")
def mega_graph(spark, base):
    """Edges of all patients by their ends, with the relation that came first."""
    r = relations(spark, base).where("g IS NOT NULL").withColumn("no", F.col("rel_id"))
    return G.mega_graph(G.build_edges(r, KEYS, "rel_id"), "relationship", "no")


@query(f"WITH {REL}, m AS (SELECT DISTINCT src, dst FROM e), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM m UNION ALL SELECT dst FROM m) GROUP BY 1 ORDER BY n DESC, id LIMIT 100) SELECT src, dst FROM m WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def subgraph_topk(spark, base):
    m = G.mega_graph(patient_edges(spark, base), "relationship")
    top = G.degrees(m, []).orderBy(F.desc("degree"), "id").limit(100)
    return G.subgraph(m, top, []).select("src", "dst")


@query(f"WITH {REL} SELECT g, id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT g, src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT g, dst, 1, 0 FROM e) GROUP BY g, id")
def vertex_degrees(spark, base):
    return G.degrees(patient_edges(spark, base), KEYS)


@query(f"WITH {REL}, d AS (SELECT g, id, count(*) AS degree FROM (SELECT g, src AS id FROM e UNION ALL SELECT g, dst FROM e) GROUP BY g, id) SELECT degree, count(*) AS vertices FROM d GROUP BY degree")
def degree_distribution(spark, base):
    return G.degrees(patient_edges(spark, base), KEYS).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


@query(f"WITH {REL}, d AS (SELECT g, id, count(*) AS degree FROM (SELECT g, src AS id FROM e UNION ALL SELECT g, dst FROM e) GROUP BY g, id) SELECT g, id, round(CASE WHEN n > 1 THEN degree / (n - 1) ELSE 1 END, 6)::DOUBLE AS centrality FROM d JOIN (SELECT g, count(*) AS n FROM d GROUP BY g) USING (g)")
def degree_centrality(spark, base):
    return G.degree_centrality(patient_edges(spark, base), KEYS).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {REL} SELECT relationship, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM e GROUP BY 1")
def relation_distribution(spark, base):
    return with_share(patient_edges(spark, base).groupBy("relationship").agg(F.count(F.lit(1)).alias("count")), "count")


def _pagerank_sql(weight: str, mega: bool) -> str:
    """The power method with the dangling mass in every round, a hundred rounds."""
    g = "'' AS g" if mega else "g"
    return f"""WITH RECURSIVE {REL}, m AS MATERIALIZED (SELECT {g}, src, dst, {weight}::DOUBLE AS w FROM e GROUP BY ALL), t AS (SELECT g, src AS id, sum(w) AS t FROM m GROUP BY ALL),
vv AS (SELECT g, src AS id FROM m UNION SELECT g, dst FROM m), v0 AS MATERIALIZED (SELECT vv.g, vv.id, count(*) OVER (PARTITION BY vv.g) AS n, t.t IS NULL AS dang FROM vv LEFT JOIN t ON t.g = vv.g AND t.id = vv.id),
p AS MATERIALIZED (SELECT m.g, m.src, m.dst, m.w / t.t AS p FROM m JOIN t ON t.g = m.g AND t.id = m.src),
pr AS (SELECT g, id, 1.0::DOUBLE / n AS r, 0 AS k FROM v0 UNION ALL
  SELECT g, id, sum(c), k + 1 FROM (
    SELECT p.g, p.dst AS id, 0.85::DOUBLE * p.p * pr.r AS c, k FROM pr JOIN p ON p.g = pr.g AND p.src = pr.id UNION ALL
    SELECT pr.g, pr.id, 0.15::DOUBLE / n + 0.85::DOUBLE * sum(CASE WHEN dang THEN r ELSE 0 END) OVER (PARTITION BY pr.g) / n, k FROM pr JOIN v0 ON v0.g = pr.g AND v0.id = pr.id)
  WHERE k < 100 GROUP BY g, id, k)
SELECT {"" if mega else "g, "}id, round(r, 6) AS rank FROM pr WHERE k = 100"""


@query(_pagerank_sql("1", False))
def pagerank(spark, base):
    """All patients' graphs in one plan."""
    return G.pagerank(patient_edges(spark, base), Scratch(spark, "pagerank"), KEYS).withColumn("rank", F.round("rank", 6))


@query(_pagerank_sql("count(*)", True))
def pagerank_weighted(spark, base):
    m = G.mega_graph(patient_edges(spark, base), "relationship")
    return G.pagerank(m, Scratch(spark, "pagerank"), weight="weight").withColumn("rank", F.round("rank", 6))


_REACH = f"WITH RECURSIVE {REL}, {BOTH}, reach AS (SELECT g, src AS x, dst AS y FROM b UNION SELECT r.g, r.x, b.dst FROM reach r JOIN b ON r.g = b.g AND r.y = b.src)"


@query(_REACH + " SELECT g, x AS id, least(x, min(y)) AS component FROM reach GROUP BY g, x")
def wcc(spark, base):
    return G.components(patient_edges(spark, base), Scratch(spark, "wcc"), KEYS)


@query(_REACH + ", c AS (SELECT g, x AS id, least(x, min(y)) AS component FROM reach GROUP BY g, x), s AS (SELECT g, component, count(*) AS n FROM c GROUP BY 1, 2) SELECT g, count(*) AS components, max(n) AS largest FROM s GROUP BY g")
def component_summary(spark, base):
    s = wcc(spark, base).groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("g").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


#: Forty rounds and one more: by then labels stand still or swing between two.
_LPA = f"""WITH RECURSIVE {REL}, {BOTH}, lp AS (SELECT DISTINCT g, src AS id, src AS community, 0 AS k FROM b UNION ALL
  SELECT g, id, arg_min(community, struct_pack(m := -n, c := community)), k + 1 FROM (SELECT b.g, b.src AS id, lp.community, lp.k, count(*) AS n FROM lp JOIN b ON b.g = lp.g AND b.dst = lp.id WHERE lp.k < 41 GROUP BY ALL) GROUP BY g, id, k),
l5 AS MATERIALIZED (SELECT g, id, min(community) AS community FROM lp WHERE k >= 40 GROUP BY g, id)"""


@query(_LPA + " SELECT g, id, community FROM l5")
def label_propagation(spark, base):
    return G.label_propagation(patient_edges(spark, base), Scratch(spark, "lpa"), KEYS)


_PATHS = f"""WITH RECURSIVE {REL}, {VERTICES}, n AS MATERIALIZED (SELECT g, count(*) AS n FROM v GROUP BY g),
w AS (SELECT g, id AS s, id AS t, 0 AS d FROM v UNION SELECT w.g, w.s, e.dst, w.d + 1 FROM w JOIN e ON w.g = e.g AND w.t = e.src JOIN n ON n.g = w.g AND w.d + 1 < n.n), p AS MATERIALIZED (SELECT g, s, t, min(d) AS d FROM w GROUP BY ALL)"""


def _paths(spark, base):
    return G.shortest_paths(patient_edges(spark, base), Scratch(spark, "paths"), KEYS)


@query(_PATHS + " SELECT g, s AS source, t AS target, d AS distance FROM p")
def bfs_paths(spark, base):
    return _paths(spark, base)


@query(_PATHS + ", f AS (SELECT g, t AS id, sum(d) AS far, count(*) AS reach FROM p WHERE d > 0 GROUP BY ALL) SELECT v.g, v.id, round(CASE WHEN n > 1 THEN coalesce(reach::DOUBLE / far * reach / (n - 1), 0) ELSE 0 END, 6) AS closeness FROM v JOIN n USING (g) LEFT JOIN f ON v.g = f.g AND v.id = f.id")
def closeness(spark, base):
    e = patient_edges(spark, base)
    return G.closeness(G.shortest_paths(e, Scratch(spark, "paths"), KEYS), G.vertices_of(e, KEYS), KEYS).withColumn("closeness", F.round("closeness", 6))


#: Every shortest path is walked, one row each; their number is what Brandes counts.
_BETWEEN = _PATHS + """, c0 AS (SELECT g, s, t, d FROM p WHERE d = 0 UNION ALL SELECT c0.g, c0.s, e.dst, c0.d + 1 FROM c0 JOIN e ON c0.g = e.g AND c0.t = e.src JOIN p ON p.g = c0.g AND p.s = c0.s AND p.t = e.dst AND p.d = c0.d + 1),
c AS MATERIALIZED (SELECT g, s, t, d, count(*)::DOUBLE AS sigma FROM c0 GROUP BY ALL),
x AS (SELECT a.g, a.t AS id, sum(a.sigma * z.sigma / st.sigma) AS b FROM c a JOIN c z ON a.g = z.g AND a.t = z.s JOIN c st ON st.g = a.g AND st.s = a.s AND st.t = z.t AND st.d = a.d + z.d WHERE a.s <> a.t AND z.s <> z.t GROUP BY ALL)
SELECT v.g, v.id, round(coalesce(b, 0) * CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 1 END, 6)::DOUBLE AS betweenness FROM v JOIN n USING (g) LEFT JOIN x ON x.g = v.g AND x.id = v.id"""


@query(_BETWEEN)
def betweenness(spark, base):
    return G.betweenness(patient_edges(spark, base), Scratch(spark, "betweenness"), KEYS).withColumn("betweenness", F.round("betweenness", 6))


_TRI = "t AS MATERIALIZED (SELECT a.g, a.src AS a, a.dst AS b, c.dst AS c FROM b a JOIN b c ON a.g = c.g AND a.dst = c.src AND a.src < a.dst AND c.src < c.dst JOIN b z ON z.g = a.g AND z.src = a.src AND z.dst = c.dst)"


@query(f"WITH {REL}, {BOTH}, {_TRI} SELECT g, a, b, c FROM t")
def triangles(spark, base):
    return G.triangles(patient_edges(spark, base), KEYS)


@query(f"WITH {REL}, {BOTH}, {_TRI}, k AS (SELECT g, src AS id, count(*) AS k FROM b GROUP BY ALL), x AS (SELECT g, unnest([a, b, c]) AS id FROM t), y AS (SELECT g, id, count(*) AS n FROM x GROUP BY ALL) SELECT k.g, k.id, coalesce(n, 0) AS triangles, round(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(n, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM k LEFT JOIN y ON y.g = k.g AND y.id = k.id")
def clustering_coefficient(spark, base):
    return G.clustering_coefficient(patient_edges(spark, base), KEYS).withColumn("clustering", F.round("clustering", 6))


@query(f"WITH {REL}, {BOTH}, k AS MATERIALIZED (SELECT g, src AS id, count(*) AS k FROM b GROUP BY ALL), c AS (SELECT x.g, x.dst AS a, y.dst AS b, count(*) AS common, sum(1 / ln(k.k)) AS aa FROM b x JOIN b y ON x.g = y.g AND x.src = y.src AND x.dst < y.dst JOIN k ON k.g = x.g AND k.id = x.src GROUP BY ALL) SELECT c.g, a, b, common, round(common / (ka.k + kb.k - common), 6)::DOUBLE AS jaccard, round(aa, 6) AS adamic_adar FROM c JOIN k ka ON ka.g = c.g AND ka.id = a JOIN k kb ON kb.g = c.g AND kb.id = b")
def common_neighbors(spark, base):
    s = G.neighbour_scores(patient_edges(spark, base), KEYS)
    return s.select("g", "a", "b", "common", F.round("jaccard", 6).alias("jaccard"), F.round("adamic_adar", 6).alias("adamic_adar"))


def _walk_sql(steps: int) -> str:
    out = [f"WITH {REL}, {VERTICES}, t AS (SELECT g, src, count(*) AS t FROM e GROUP BY ALL), p AS MATERIALIZED (SELECT e.g, e.src, e.dst, 1.0::DOUBLE / t AS p FROM e JOIN t ON t.g = e.g AND t.src = e.src), m0 AS (SELECT g, id AS start, id, 1.0::DOUBLE AS mass FROM v)"]
    for i in range(steps):
        out.append(f"m{i + 1} AS MATERIALIZED (SELECT m.g, m.start, p.dst AS id, sum(m.mass * p.p * 0.8::DOUBLE) AS mass FROM m{i} m JOIN p ON p.g = m.g AND p.src = m.id GROUP BY ALL)")
    return ", ".join(out) + " SELECT g, start, id, round(sum(mass), 6) AS mass FROM (" + " UNION ALL ".join(f"SELECT * FROM m{i + 1}" for i in range(steps)) + ") GROUP BY ALL"


@query(_walk_sql(3))
def random_walk_mass(spark, base):
    return G.walk_mass(patient_edges(spark, base), KEYS).withColumn("mass", F.round("mass", 6))


@query(f"WITH {REL} SELECT x.g, x.src AS v0, x.dst AS v1, y.dst AS v2 FROM e x JOIN e y ON x.g = y.g AND x.dst = y.src WHERE x.relationship = 'causes' AND y.relationship = 'treated with' AND x.src <> y.dst")
def motif_paths(spark, base):
    return G.chains(patient_edges(spark, base), KEYS, ["causes", "treated with"], "relationship")


@query(f"WITH {REL}, a AS (SELECT DISTINCT g, src, dst FROM e WHERE relationship = 'causes'), b AS (SELECT DISTINCT g, src, dst FROM e WHERE relationship = 'is a symptom of') SELECT g, count(*) FILTER (a.src IS NULL OR b.src IS NULL) AS distance FROM a FULL JOIN b USING (g, src, dst) GROUP BY g")
def graph_edit_distance(spark, base):
    e = patient_edges(spark, base)
    return G.edit_distance(e.where("relationship = 'causes'"), e.where("relationship = 'is a symptom of'"), KEYS, ["src", "dst"])


@query(f"""WITH {REL}, {BOTH}, c0 AS (SELECT g, src AS id, count(*)::VARCHAR AS colour FROM b GROUP BY ALL),
c1 AS MATERIALIZED (SELECT b.g, b.src AS id, md5(any_value(o.colour) || '|' || string_agg(n.colour, ',' ORDER BY n.colour)) AS colour FROM b JOIN c0 n ON n.g = b.g AND n.id = b.dst JOIN c0 o ON o.g = b.g AND o.id = b.src GROUP BY ALL),
c2 AS (SELECT b.g, b.src AS id, md5(any_value(o.colour) || '|' || string_agg(n.colour, ',' ORDER BY n.colour)) AS colour FROM b JOIN c1 n ON n.g = b.g AND n.id = b.dst JOIN c1 o ON o.g = b.g AND o.id = b.src GROUP BY ALL)
SELECT g, id, colour FROM c2""")
def wl_colors(spark, base):
    return G.wl_colours(patient_edges(spark, base), Scratch(spark, "wl"), KEYS)


@query(f"WITH RECURSIVE {REL}, {VERTICES}, r AS (SELECT g, id AS s, id AS t FROM v UNION SELECT r.g, r.s, e.dst FROM r JOIN e ON r.g = e.g AND r.t = e.src) SELECT a.g, a.s AS id, min(a.t) AS component FROM r a JOIN r z ON a.g = z.g AND a.s = z.t AND a.t = z.s GROUP BY ALL")
def strong_components(spark, base):
    return G.strong_components(patient_edges(spark, base), Scratch(spark, "strong"), KEYS)


#: Relations in both directions, so that there are cycles.
_ROUND = "ee AS (SELECT g, src, dst FROM e WHERE relationship <> 'causes' UNION SELECT g, dst, src FROM e WHERE relationship = 'treated with')"


@query(f"WITH RECURSIVE {REL}, {_ROUND}, v AS (SELECT g, src AS id FROM ee UNION SELECT g, dst FROM ee), r AS (SELECT g, id AS s, id AS t FROM v UNION SELECT r.g, r.s, ee.dst FROM r JOIN ee ON r.g = ee.g AND r.t = ee.src) SELECT a.g, a.s AS id, min(a.t) AS component FROM r a JOIN r z ON a.g = z.g AND a.s = z.t AND a.t = z.s GROUP BY ALL")
def strong_components_round(spark, base):
    """Strong components where treatments count in both directions: the patients' own edges hold no cycle."""
    return G.strong_components(_round_edges(spark, base), Scratch(spark, "strong"), KEYS)


def _round_edges(spark, base):
    e = patient_edges(spark, base)
    return e.where("relationship != 'causes'").select("g", "src", "dst").unionByName(e.where("relationship = 'treated with'").select("g", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS weight FROM l a JOIN l b ON a.p = b.p AND a.s < b.s GROUP BY ALL")
def bipartite_projection(spark, base):
    return G.bipartite_projection(table(spark, base, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query(f"WITH {REL} SELECT g, src AS id, list_sort(list(DISTINCT dst)) AS neighbours FROM e GROUP BY ALL")
def adjacency_lists(spark, base):
    return G.adjacency_lists(patient_edges(spark, base), KEYS)


@query(f"WITH {REL}, {BOTH}, s AS (SELECT g, src AS id, list_sort(list(DISTINCT dst)) AS l FROM b GROUP BY ALL) SELECT g, id, min(id) OVER (PARTITION BY g, l) AS role FROM s")
def structural_equivalence(spark, base):
    return G.structural_classes(patient_edges(spark, base), KEYS)


@query(f"WITH {REL} SELECT g, src AS id, list_sort(list(dst))[1:2] AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY dst) AS rn FROM e) WHERE rn <= 2 GROUP BY ALL")
def neighbour_context(spark, base):
    return G.adjacency_lists(patient_edges(spark, base), KEYS).select("g", "id", F.slice("neighbours", 1, 2).alias("neighbours"))


_KATZ = f"""WITH RECURSIVE {REL}, {VERTICES}, x AS (SELECT g, id, 1.0::DOUBLE AS value, 0 AS k FROM v UNION ALL
  SELECT g, id, sum(c), k + 1 FROM (SELECT e.g, e.dst AS id, 0.1::DOUBLE * x.value AS c, k FROM x JOIN e ON e.g = x.g AND e.src = x.id UNION ALL SELECT g, id, 1.0::DOUBLE, k FROM x) WHERE k < 60 GROUP BY g, id, k)
SELECT g, id, round(value / sqrt(sum(value * value) OVER (PARTITION BY g)), 6) AS value FROM x WHERE k = 60"""


@query(_KATZ)
def katz_centrality(spark, base):
    return G.power_iteration(patient_edges(spark, base), Scratch(spark, "katz"), None, 0.1, KEYS).withColumn("value", F.round("value", 6))


@query(f"""WITH RECURSIVE {REL}, {BOTH}, x AS (SELECT DISTINCT g, src AS id, 1.0::DOUBLE AS value, 0 AS k FROM b UNION ALL
  SELECT g, id, sum(c), k + 1 FROM (SELECT b.g, b.dst AS id, x.value AS c, k FROM x JOIN b ON b.g = x.g AND b.src = x.id UNION ALL SELECT g, id, value, k FROM x) WHERE k < 8 GROUP BY g, id, k)
SELECT g, id, round(value / sqrt(sum(value * value) OVER (PARTITION BY g)), 6) AS value FROM x WHERE k = 8""")
def eigenvector_rounds(spark, base):
    """Eight rounds of the power method on undirected edges."""
    return G.power_iteration(G.undirected(patient_edges(spark, base), KEYS), Scratch(spark, "eigen"), 8, None, KEYS).withColumn("value", F.round("value", 6))


@query()
def eigenvector_centrality(spark, base):
    """Of the merged graph, undirected (graphs without cycles have none by directed edges), until no value moves by more than 0.0001."""
    m = G.undirected(G.mega_graph(patient_edges(spark, base), "relationship"), [])
    return G.power_iteration(m, Scratch(spark, "eigen"), None, None, (), 1e-4).withColumn("value", F.round("value", 3))


@query(f"WITH RECURSIVE {REL}, {_ROUND}, r AS (SELECT g, src AS s, dst AS t FROM ee UNION SELECT r.g, r.s, ee.dst FROM r JOIN ee ON r.g = ee.g AND r.t = ee.src), c AS (SELECT DISTINCT g, s AS id FROM r WHERE s = t) SELECT DISTINCT v.g, v.id FROM (SELECT g, src AS id FROM ee UNION SELECT g, dst FROM ee) v WHERE (EXISTS (SELECT 1 FROM c WHERE c.g = v.g AND c.id = v.id)) OR (EXISTS (SELECT 1 FROM r JOIN c ON c.g = r.g AND c.id = r.s WHERE r.g = v.g AND r.t = v.id) AND EXISTS (SELECT 1 FROM r JOIN c ON c.g = r.g AND c.id = r.t WHERE r.g = v.g AND r.s = v.id))")
def cyclic_vertices(spark, base):
    """Vertices on cycles or between them, treatments counting in both directions."""
    return G.cyclic_vertices(_round_edges(spark, base), Scratch(spark, "cycles"), KEYS)


@query(f"WITH {REL}, {BOTH}, d AS (SELECT g, src, count(*) AS d FROM b GROUP BY ALL), t AS (SELECT a.g, count(*) AS n FROM b a JOIN b c ON a.g = c.g AND a.dst = c.src AND a.src < a.dst AND c.src < c.dst JOIN b z ON z.g = a.g AND z.src = a.src AND z.dst = c.dst GROUP BY 1), s AS (SELECT g, (sum(d) / 2)::BIGINT AS edges, sum(d * (d - 1) / 2)::BIGINT AS pairs FROM d GROUP BY 1) SELECT s.g, edges, pairs - 3 * coalesce(n, 0) AS wedges, coalesce(n, 0) AS triangles FROM s LEFT JOIN t ON t.g = s.g")
def graphlet_counts(spark, base):
    return G.graphlets(patient_edges(spark, base), KEYS)


@query(f"WITH {REL}, {BOTH}, w AS (SELECT x.g, CASE WHEN y.dst = x.src THEN '0-1-0' ELSE '0-1-2' END AS pattern FROM b x JOIN b y ON x.g = y.g AND x.dst = y.src) SELECT g, pattern, count(*) AS walks FROM w GROUP BY ALL")
def anonymous_walks(spark, base):
    return G.anonymous_walks(patient_edges(spark, base), KEYS)


@query("WITH c AS (SELECT c_nationkey AS k, o_orderstatus AS l, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT k, sqrt(sum(n * n)) AS s FROM c GROUP BY 1) SELECT a.k AS a, b.k AS b, round(sum(a.n * b.n) / (any_value(x.s) * any_value(y.s)), 6) AS kernel FROM c a JOIN c b ON a.l = b.l AND a.k < b.k JOIN s x ON x.k = a.k JOIN s y ON y.k = b.k GROUP BY 1, 2")
def label_kernel(spark, base):
    """Graphs of countries' customers against each other by the mix of their order states."""
    o = table(spark, base, "orders").join(table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return G.label_kernel(o.select(F.col("c_nationkey").alias("g"), F.col("o_orderstatus").alias("kind")), ["g"], "kind").withColumn("kernel", F.round("kernel", 6))


@query()
def greedy_colours(spark, base):
    return G.greedy_colours(patient_edges(spark, base), Scratch(spark, "colours"), KEYS)


@query()
def modularity_communities(spark, base):
    return G.modularity_communities(patient_edges(spark, base), KEYS)


@query()
def node_embeddings(spark, base):
    """Skip-gram vectors over hash-drawn walks of the merged graph."""
    from pyspark.ml.functions import vector_to_array

    m = G.mega_graph(patient_edges(spark, base), "relationship")
    return G.walk_embeddings(m).select("id", vector_to_array("vector").alias("vector"))


@query("WITH RECURSIVE t AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a AS src, b AS dst, count(*) AS weight FROM t WHERE b IS NOT NULL GROUP BY ALL")
def transition_graph(spark, base):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, base, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return t.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _dijkstra_sql(sources: str) -> str:
    return f"""WITH RECURSIVE {REL}, m AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) AS w FROM e GROUP BY ALL), v AS (SELECT src AS id FROM m UNION SELECT dst FROM m), n AS (SELECT count(*) AS n FROM v), s AS ({sources}),
p AS (SELECT id AS source, id AS target, 0.0::DOUBLE AS d, 0 AS k FROM s UNION SELECT p.source, m.dst, round(min(p.d + m.w), 9), p.k + 1 FROM p JOIN m ON p.target = m.src JOIN n ON p.k + 1 < n.n GROUP BY p.source, m.dst, p.k)
SELECT source, target, round(min(d), 6) AS distance FROM p GROUP BY ALL"""


@query(_dijkstra_sql("SELECT min(src) AS id FROM m"))
def dijkstra_paths(spark, base):
    """Least-weight distances of the merged graph from one source, its smallest vertex, relaxed until nothing improves; frequent edges are short."""
    m = _lengths(spark, base)
    return G.weighted_paths(m, Scratch(spark, "dijkstra"), "w", m.agg(F.min("src").alias("id"))).withColumn("distance", F.round("distance", 6))


@query(_dijkstra_sql("SELECT id FROM v"))
def dijkstra_all_paths(spark, base):
    """The same from every vertex, however many edges a path takes."""
    m = _lengths(spark, base)
    return G.weighted_paths(m, Scratch(spark, "dijkstra"), "w", G.vertices_of(m, [])).withColumn("distance", F.round("distance", 6))


def _lengths(spark, base):
    return G.mega_graph(patient_edges(spark, base), "relationship").withColumn("w", 1.0 / F.col("weight"))
