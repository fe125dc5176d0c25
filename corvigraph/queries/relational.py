"""Scans, projections, joins, aggregates, windows and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import relational as R
from ..registry import query
from ..sources.tables import table


def entity_rows(spark: SparkSession, base: str) -> DataFrame:
    """rag_entities exploded: empty and null arrays give no row."""
    return table(spark, base, "rag_entities").select("case_id", F.explode("entities").alias("e")).select("case_id", "e.text", "e.category", "e.assertion", "e.section", "e.is_critical", "e.score")


ENTITIES = "entity_rows AS (SELECT case_id, e.text, e.category, e.assertion, e.section, e.is_critical, e.score FROM (SELECT case_id, unnest(entities) AS e FROM rag_entities))"


@query("SELECT count(*) AS reports, CAST(sum(num_entities) AS BIGINT) AS entities, round(avg(num_entities), 6) AS avg_entities, min(num_entities) AS min_entities, max(num_entities) AS max_entities, quantile_cont(num_entities, 0.5) AS median_entities FROM rag_entities")
def report_stats(spark, base):
    n = "num_entities"
    return table(spark, base, "rag_entities").agg(F.count(F.lit(1)).alias("reports"), F.sum(n).alias("entities"), F.round(F.avg(n), 6).alias("avg_entities"), F.min(n).alias("min_entities"), F.max(n).alias("max_entities"), F.percentile(n, F.lit(0.5)).alias("median_entities"))


@query(f"WITH {ENTITIES} SELECT category, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM entity_rows GROUP BY category")
def category_distribution(spark, base):
    return R.with_share(entity_rows(spark, base).groupBy("category").agg(F.count(F.lit(1)).alias("count")), "count")


@query(f"WITH {ENTITIES} SELECT assertion, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM entity_rows GROUP BY assertion")
def assertion_distribution(spark, base):
    return R.with_share(entity_rows(spark, base).groupBy("assertion").agg(F.count(F.lit(1)).alias("count")), "count")


@query(f"WITH {ENTITIES} SELECT section, count(*) AS mentions, count(DISTINCT case_id) AS cases FROM entity_rows GROUP BY section ORDER BY mentions DESC")
def section_distribution(spark, base):
    return entity_rows(spark, base).groupBy("section").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("case_id").alias("cases")).orderBy(F.desc("mentions"))


@query("SELECT coalesce(reader, 'unknown') AS reader, count(*) AS reports, count(DISTINCT case_id) AS cases, round(avg(length(findings)), 4) AS avg_findings FROM reports_lean GROUP BY 1")
def reader_distribution(spark, base):
    return table(spark, base, "reports_lean").groupBy(F.coalesce("reader", F.lit("unknown")).alias("reader")).agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("case_id").alias("cases"), F.round(F.avg(F.length("findings")), 4).alias("avg_findings"))


@query(f"WITH {ENTITIES} SELECT count(DISTINCT case_id) AS critical_reports, round(100.0 * count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM rag_entities), 1)::DOUBLE AS pct FROM entity_rows WHERE is_critical")
def critical_reports_share(spark, base):
    total = table(spark, base, "rag_entities").agg(F.countDistinct("case_id").alias("total"))
    return entity_rows(spark, base).where("is_critical").agg(F.countDistinct("case_id").alias("critical_reports")).crossJoin(total).select("critical_reports", F.round(100.0 * F.col("critical_reports") / F.col("total"), 1).alias("pct"))


@query(f"WITH {ENTITIES} SELECT clean(text) AS entity, category, count(*) AS mentions FROM entity_rows WHERE text IS NOT NULL GROUP BY 1, 2 ORDER BY mentions DESC, entity, category NULLS FIRST LIMIT 30")
def top_entities(spark, base):
    return entity_rows(spark, base).where("text IS NOT NULL").groupBy(clean(F.col("text")).alias("entity"), "category").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "entity", "category").limit(30)


@query(f"WITH {ENTITIES} SELECT clean(text) AS entity, count(*) AS mentions, count(DISTINCT case_id) AS cases, round(avg(score), 6) AS avg_score FROM entity_rows WHERE is_critical AND assertion = 'present' AND text IS NOT NULL GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 20")
def critical_breakdown(spark, base):
    return entity_rows(spark, base).where("is_critical AND assertion = 'present' AND text IS NOT NULL").groupBy(clean(F.col("text")).alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("case_id").alias("cases"), F.round(F.avg("score"), 6).alias("avg_score")).orderBy(F.desc("mentions"), "entity").limit(20)


@query("SELECT count(*) AS zero_entity_reports FROM rag_entities WHERE num_entities = 0")
def zero_entity_reports(spark, base):
    return table(spark, base, "rag_entities").where("num_entities = 0").agg(F.count(F.lit(1)).alias("zero_entity_reports"))


@query("SELECT case_id, processed_at, list_transform(entities[1:3], lambda e: concat(coalesce(e.text, ''), ' [', coalesce(e.assertion, ''), ']')) AS shown FROM rag_entities WHERE num_entities > 3")
def sample_entities_hof(spark, base):
    label = lambda e: F.concat(F.coalesce(e["text"], F.lit("")), F.lit(" ["), F.coalesce(e["assertion"], F.lit("")), F.lit("]"))
    return table(spark, base, "rag_entities").where("num_entities > 3").select("case_id", "processed_at", F.transform(F.slice("entities", 1, 3), label).alias("shown"))


@query("SELECT r.report_id, r.case_id, e.processed_at, e.num_entities FROM reports_lean r JOIN rag_entities e ON r.case_id = e.case_id AND CAST(r.reported_at AS DATE) = CAST(e.processed_at AS DATE) WHERE r.case_id NOT LIKE 'DEMO_%'")
def ab_two_key_join(spark, base):
    reports = table(spark, base, "reports_lean").where(~F.col("case_id").like("DEMO_%")).select("report_id", "case_id", F.to_date("reported_at").alias("day"))
    entities = table(spark, base, "rag_entities").select("case_id", F.to_date("processed_at").alias("day"), "processed_at", "num_entities")
    return reports.join(entities, ["case_id", "day"]).select("report_id", "case_id", "processed_at", "num_entities")


@query("SELECT r.report_id, r.case_id, m.n AS entity_rows, coalesce(m.n, 0) AS entity_rows_or_0 FROM reports_lean r LEFT JOIN (SELECT case_id, count(*) AS n FROM rag_entities GROUP BY case_id) m USING (case_id)")
def metrics_left_join(spark, base):
    m = table(spark, base, "rag_entities").groupBy("case_id").agg(F.count(F.lit(1)).alias("entity_rows"))
    return table(spark, base, "reports_lean").select("report_id", "case_id").join(m, "case_id", "left").withColumn("entity_rows_or_0", F.coalesce("entity_rows", F.lit(0)))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def star_join(spark, base):
    o, c, n = (table(spark, base, t) for t in ("orders", "customer", "nation"))
    return o.where("o_totalprice > 300000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT r.report_id FROM reports_lean r WHERE EXISTS (SELECT 1 FROM rag_entities e WHERE e.case_id = r.case_id AND e.num_entities > 5)")
def semi_join_reports(spark, base):
    return table(spark, base, "reports_lean").join(table(spark, base, "rag_entities").where("num_entities > 5"), "case_id", "left_semi").select("report_id")


@query("SELECT DISTINCT r.case_id FROM reports_lean r WHERE NOT EXISTS (SELECT 1 FROM rag_entities e WHERE e.case_id = r.case_id)")
def anti_join_reports(spark, base):
    return table(spark, base, "reports_lean").join(table(spark, base, "rag_entities"), "case_id", "left_anti").select("case_id").distinct()


@query(f"WITH {ENTITIES}, one AS (SELECT DISTINCT case_id, category AS c FROM entity_rows WHERE category IS NOT NULL) SELECT a.case_id, a.c AS a, b.c AS b FROM one a JOIN one b ON a.case_id = b.case_id AND a.c < b.c")
def pairs_theta_join(spark, base):
    return R.pairs_within(entity_rows(spark, base), ["case_id"], "category")


@query("WITH t AS (SELECT DISTINCT clean(source_entity_name) AS s FROM clinical_relationships WHERE length(clean(source_entity_name)) > 0) SELECT a.s AS parent, b.s AS child FROM t a JOIN t b ON a.s <> b.s AND contains(b.s, a.s)")
def substring_join(spark, base):
    """Terms that contain another term."""
    from ..operators.ontology import contained_terms

    terms = table(spark, base, "clinical_relationships").select(clean(F.col("source_entity_name")).alias("term"))
    return contained_terms(terms, whole_words=False)


@query("SELECT least(a.s_suppkey, b.s_suppkey) AS lo, greatest(a.s_suppkey, b.s_suppkey) AS hi, count(*) AS n FROM (SELECT s_suppkey, s_nationkey FROM supplier) a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2")
def bidirectional_pairs(spark, base):
    s = table(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    both = s.withColumnRenamed("s_suppkey", "x").join(s.withColumnRenamed("s_suppkey", "y"), "s_nationkey").where("x != y")
    lo, hi = R.canonical_pair("x", "y")
    return both.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.l_orderkey, a.l_extendedprice AS first_price, b.l_extendedprice AS second_price, round(b.l_extendedprice - a.l_extendedprice, 4) AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE abs(b.l_extendedprice - a.l_extendedprice) > 10000")
def self_comparison(spark, base):
    items = table(spark, base, "lineitem")
    a = items.where("l_linenumber = 1").select("l_orderkey", F.col("l_extendedprice").alias("first_price"))
    b = items.where("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("second_price"))
    return a.join(b, "l_orderkey").where("abs(second_price - first_price) > 10000").withColumn("delta", F.round(F.col("second_price") - F.col("first_price"), 4))


@query("SELECT e.user_id, e.event_id, max(p.event_id) AS previous_id FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 1 HOUR GROUP BY ALL")
def range_join(spark, base):
    """Events of the hour before, per user: the range is bucketed by hour, so that the join has equal keys."""
    e = table(spark, base, "events").select("user_id", "event_id", "ts")
    hour = F.date_trunc("hour", "ts")
    left = e.withColumn("bucket", F.explode(F.array(hour, hour - F.expr("INTERVAL 1 HOUR"))))
    right = e.select("user_id", F.col("event_id").alias("previous"), F.col("ts").alias("before"), hour.alias("bucket")).withColumnRenamed("bucket", "bucket")
    hit = left.join(right, ["user_id", "bucket"]).where("before < ts AND before >= ts - INTERVAL 1 HOUR")
    return hit.groupBy("user_id", "event_id").agg(F.max("previous").alias("previous_id"))


@query("SELECT e.event_id, o.o_orderdate AS last_order FROM events e ASOF LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts")
def asof_join(spark, base):
    """The latest order before each event: one sort per key over the union, no pair join."""
    e = table(spark, base, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("timestamp_ntz").alias("order_t"))
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("order_t"))
    w = Window.partitionBy("k").orderBy("t", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("last_order", F.last("order_t", True).over(w)).where("event_id IS NOT NULL").select("event_id", "last_order")


@query("SELECT patient_rowkey, string_agg(evidence, chr(10) || chr(10) ORDER BY rel_id) AS evidence FROM clinical_relationships WHERE evidence IS NOT NULL AND patient_rowkey IS NOT NULL GROUP BY patient_rowkey")
def evidence_concat(spark, base):
    e = table(spark, base, "clinical_relationships").where("evidence IS NOT NULL AND patient_rowkey IS NOT NULL")
    return e.groupBy("patient_rowkey").agg(F.array_sort(F.collect_list(F.struct("rel_id", "evidence"))).alias("x")).select("patient_rowkey", F.array_join("x.evidence", "\n\n").alias("evidence"))


@query("SELECT case_id, report_id, reader FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at, report_id) AS rn FROM reports_lean) WHERE rn = 1")
def dedup_keep_first(spark, base):
    r = table(spark, base, "reports_lean").select("case_id", "report_id", "reader", "loaded_at")
    return R.first_per_key(r, ["case_id"], [F.col("loaded_at"), F.col("report_id")]).select("case_id", "report_id", "reader")


@query(f"WITH {ENTITIES} SELECT case_id, clean(text) AS entity, max(score) AS score FROM entity_rows WHERE text IS NOT NULL GROUP BY 1, 2")
def dedup_max_score(spark, base):
    return entity_rows(spark, base).where("text IS NOT NULL").groupBy("case_id", clean(F.col("text")).alias("entity")).agg(F.max("score").alias("score"))


@query(f"WITH {ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC NULLS LAST, text NULLS FIRST, section NULLS FIRST, category NULLS FIRST, assertion NULLS FIRST) AS rn FROM entity_rows) SELECT case_id, text, score FROM r WHERE rn = 1")
def dedup_max_row(spark, base):
    return R.best_per_key(entity_rows(spark, base), ["case_id"], "score", ["text", "section", "category", "assertion"]).select("case_id", "text", "score")


@query("SELECT l_returnflag, round(avg(l_quantity), 3) AS mean_qty, round(stddev_samp(l_quantity), 3) AS std_qty, round(avg(l_discount), 3) AS mean_disc, round(stddev_samp(l_discount), 3) AS std_disc FROM lineitem GROUP BY 1")
def mean_std(spark, base):
    return table(spark, base, "lineitem").groupBy("l_returnflag").agg(*[F.round(f(c), 3).alias(n) for c, s in (("l_quantity", "qty"), ("l_discount", "disc")) for f, n in ((F.avg, f"mean_{s}"), (F.stddev_samp, f"std_{s}"))])


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 3) AS mean_price, round(avg((l_discount > 0.05)::INT), 6) AS high_rate, round(1 - avg((l_discount > 0.05)::INT), 6) AS low_rate FROM lineitem GROUP BY 1, 2")
def group_rates(spark, base):
    high = F.avg((F.col("l_discount") > 0.05).cast("int"))
    return table(spark, base, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 3).alias("mean_price"), F.round(high, 6).alias("high_rate"), F.round(1 - high, 6).alias("low_rate"))


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1")
def pivot_mean(spark, base):
    p = table(spark, base, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return p.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@query(f"WITH {ENTITIES} SELECT section, count(*) FILTER (assertion = 'present') AS present, count(*) FILTER (assertion = 'absent') AS absent, count(*) FILTER (assertion = 'possible') AS possible FROM entity_rows GROUP BY 1")
def unstack_counts(spark, base):
    values = ["present", "absent", "possible"]
    return entity_rows(spark, base).groupBy("section").pivot("assertion", values).count().na.fill(0, values)


@query("SELECT p_brand, arg_max(p_type, struct_pack(a := m, b := p_type)) AS best_type, round(max(m), 6) AS best FROM (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1")
def argmax_group(spark, base):
    m = table(spark, base, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("m"))
    return m.groupBy("p_brand").agg(F.max_by("p_type", F.struct("m", "p_type")).alias("best_type"), F.round(F.max("m"), 6).alias("best"))


@query("SELECT flag, round(sum(a) / greatest(sum(t), 1), 6) AS ratio FROM (SELECT l_returnflag AS flag, (l_discount > 0.05)::DOUBLE AS a, 1.0::DOUBLE AS t FROM lineitem) GROUP BY 1")
def ratio_of_sums(spark, base):
    return table(spark, base, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum((F.col("l_discount") > 0.05).cast("double")) / F.greatest(F.sum(F.lit(1.0)), F.lit(1)), 6).alias("ratio"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def regression_slope(spark, base):
    return table(spark, base, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


@query("SELECT source, round(avg(n), 6) AS avg_words FROM (SELECT coalesce(source, '') AS source, len(string_split_regex(trim(text), ' +')) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def mean_list_length(spark, base):
    d = table(spark, base, "documents").where("text IS NOT NULL")
    return d.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.round(F.avg(F.size(F.split(F.trim("text"), " +"))), 6).alias("avg_words"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS q2, round(quantile_cont(p_retailprice, 0.75), 6) AS q3 FROM part GROUP BY 1")
def quartiles(spark, base):
    return table(spark, base, "part").groupBy("p_brand").agg(*[F.round(F.percentile("p_retailprice", F.lit(q)), 6).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


@query("SELECT bin, count(*) AS count FROM (SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 50)), 49)::INT AS bin FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)) GROUP BY 1")
def histogram_bins(spark, base):
    return R.histogram(table(spark, base, "part"), "p_retailprice", 50)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(spark, base):
    return table(spark, base, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk_nlargest(spark, base):
    return table(spark, base, "documents").select("doc_id", "n_chars").where("n_chars IS NOT NULL").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) ORDER BY abs(o_totalprice - m), o_orderkey LIMIT 1")
def median_case(spark, base):
    return R.nearest_to_median(table(spark, base, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("""(SELECT 'largest' AS strategy, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL
(SELECT 'smallest', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL
(SELECT 'earliest', o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) UNION ALL
(SELECT 'latest', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) UNION ALL
(SELECT 'median', o_orderkey FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) ORDER BY abs(o_totalprice - m), o_orderkey LIMIT 1)""")
def representative_cases(spark, base):
    """Five strategies that each pick one case."""
    o = table(spark, base, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    pick = lambda name, *order: o.orderBy(*order, "o_orderkey").limit(1).select(F.lit(name).alias("strategy"), "o_orderkey")
    median = R.nearest_to_median(o, "o_totalprice", "o_orderkey").select(F.lit("median").alias("strategy"), "o_orderkey")
    return R.concat_frames([pick("largest", F.desc("o_totalprice")), pick("smallest", "o_totalprice"), pick("earliest", "o_orderdate"), pick("latest", F.desc("o_orderdate")), median])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || substring(md5('42-' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 = 0")
def random_order_sample(spark, base):
    """Bernoulli sample of a hundredth by a hash of the key: the same rows on every run."""
    return R.sample_by_digest(table(spark, base, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark, base):
    return R.top_per_group(table(spark, base, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS next, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS value_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_ranking(spark, base):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, base, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("previous"), F.lead("event_type").over(w).alias("next"), F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).alias("value_rank"))


_SETS = f"WITH {ENTITIES}, a AS (SELECT DISTINCT case_id, clean(text) AS t FROM entity_rows WHERE section = 'findings' AND text IS NOT NULL), b AS (SELECT DISTINCT case_id, clean(text) AS t FROM entity_rows WHERE section = 'conclusions' AND text IS NOT NULL)"


def _sections(spark, base):
    e = entity_rows(spark, base).where("text IS NOT NULL").select("case_id", "section", clean(F.col("text")).alias("t"))
    return tuple(e.where(F.col("section") == s).select("case_id", "t").distinct() for s in ("findings", "conclusions"))


@query(_SETS + " SELECT case_id, count(*) AS union_size FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1")
def set_union(spark, base):
    a, b = _sections(spark, base)
    return a.union(b).distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("union_size"))


@query(_SETS + " SELECT case_id, count(*) AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1")
def set_intersection(spark, base):
    a, b = _sections(spark, base)
    return a.intersect(b).groupBy("case_id").agg(F.count(F.lit(1)).alias("shared"))


@query(_SETS + " SELECT * FROM a EXCEPT SELECT * FROM b")
def set_difference(spark, base):
    a, b = _sections(spark, base)
    return a.exceptAll(b)


@query(_SETS + ", s AS (SELECT case_id, list(DISTINCT t) FILTER (f) AS x, list(DISTINCT t) FILTER (NOT f) AS y FROM (SELECT *, true AS f FROM a UNION ALL SELECT *, false FROM b) GROUP BY 1) SELECT case_id, round(len(list_intersect(coalesce(x, []), coalesce(y, []))) / len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), 6) AS jaccard, len(list_intersect(coalesce(x, []), coalesce(y, []))) = len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS equal FROM s")
def set_jaccard(spark, base):
    a, b = _sections(spark, base)
    both = a.withColumn("f", F.lit(True)).unionByName(b.withColumn("f", F.lit(False)))
    s = both.groupBy("case_id").agg(F.collect_set(F.when(F.col("f"), F.col("t"))).alias("x"), F.collect_set(F.when(~F.col("f"), F.col("t"))).alias("y"))
    shared, every = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return s.select("case_id", F.round(shared / every, 6).alias("jaccard"), (F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x")) == 0).alias("equal"))


@query("SELECT 'orders' AS kind, o_orderkey AS id, CAST(NULL AS VARCHAR) AS name FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def row_concat(spark, base):
    o = table(spark, base, "orders").where("o_orderstatus = 'P'").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"))
    c = table(spark, base, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.concat_frames([o, c])
