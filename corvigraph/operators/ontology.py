"""Term hierarchies, rule relations, co-occurrence matrices, retrieval and compound terms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _words(terms: DataFrame) -> DataFrame:
    return terms.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("word")).where("word != ''")


def _grams(text: Column, size: Column) -> Column:
    count = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, size)))


def substring_matches(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): every text of ``hays`` (hay) that holds a text of ``needles`` (needle), each pair once; empty needles match nothing.

    A hay holds a needle only if it holds all its pieces of three signs (of shorter needles: the needle), so
    the block key of a needle is the one of them that the fewest hays have. Exact, and no pair is compared twice.
    """
    n = needles.where(F.length("needle") > 0).select("needle").distinct()
    h = hays.where(F.length("hay") > 0).select("hay").distinct()
    every = F.array_distinct(F.flatten(F.array(*[F.when(F.length("hay") >= k, _grams(F.col("hay"), F.lit(k))).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)])))
    held = h.select("hay", F.explode(every).alias("gram"))
    freq = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = n.select("needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(3)))).alias("gram")).join(freq, "gram")
    keyed = asked.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return keyed.join(held, "gram").where("contains(hay, needle)").select("needle", "hay")


def contained_terms(terms: DataFrame, whole_words: bool = True) -> DataFrame:
    """(parent, child): terms that hold another, as whole words or, without ``whole_words``, as any piece of their text."""
    found = substring_matches(terms.select(F.col("term").alias("needle")), terms.select(F.col("term").alias("hay")))
    found = found.where("contains(concat(' ', hay, ' '), concat(' ', needle, ' '))") if whole_words else found
    return found.where("needle != hay").select(F.col("needle").alias("parent"), F.col("hay").alias("child"))


# Compound patterns and the words that form compounds with them.
COMPOUND_PATTERNS = {
    "vaccination": ["vaccine", "immunization"],
    "medication": ["drug", "medicine", "therapeutic"],
    "surgery": ["surgical", "operation", "procedure"],
    "therapy": ["treatment", "therapeutic"],
    "diagnosis": ["diagnostic", "finding"],
    "management": ["treatment", "care"],
}


def compound_pairs(spark) -> DataFrame:
    """(parent, child): the compounds made of the patterns."""
    return spark.createDataFrame([(w, f"{w} {name}") for name, words in COMPOUND_PATTERNS.items() for w in words], "parent string, child string")


def hierarchy_pairs(terms: DataFrame, is_a: DataFrame, fixed: DataFrame, whole_words: bool = False) -> DataFrame:
    """(parent, child, source) from contained terms, "is a" triples (object above subject) and a fixed list.

    Ends of triples have at least three signs, differ and are no numbers.
    """
    a = contained_terms(terms, whole_words).withColumn("source", F.lit("substring"))
    real = (F.length("subject") >= 3) & (F.length("object") >= 3) & ~F.col("subject").rlike("^[0-9]+$") & ~F.col("object").rlike("^[0-9]+$") & (F.col("subject") != F.col("object"))
    b = is_a.where(real).select(F.col("object").alias("parent"), F.col("subject").alias("child"), F.lit("is_a").alias("source"))
    return a.unionByName(b).unionByName(fixed.select("parent", "child", F.lit("fixed").alias("source"))).distinct()


def relevance(mapping_hit: Column, triple_hit: Column, type_hit: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * mapping_hit.cast("int") + 0.4 * triple_hit.cast("int") + 0.2 * type_hit.cast("int"))


def boost(confidence: Column, relevant: Column) -> Column:
    return F.least(F.lit(1.0), confidence + 0.3 * relevant)


def rule_relations(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``pairs`` (a, b, text, ...) with ``kind`` and ``confidence`` by words of the text, in order of precedence, else by a known triple at 0.8.

    Words of treatment type a pair only if both ends are medical terms; otherwise no other words are asked.
    A triple (subject, predicate, object) is of the pair if its ends hold the pair's, in either direction; of
    several predicates the smallest counts. Null where nothing says.
    """
    from ..functions.terms import is_medical

    low = F.lower("text")
    a, b = F.col("a"), F.col("b")
    rule = (
        F.when(low.rlike("treat|for|manage"), F.when(is_medical(a) & is_medical(b), "treats"))
        .when(low.rlike("prevent|against"), "prevents")
        .when(low.rlike("cause|due to"), "causes")
        .when(F.contains(a, b) | F.contains(b, a), "part_of")
    )
    wanted = pairs.select("a", "b").distinct()
    t = triples.where("subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL").select("subject", "predicate", "object").distinct()
    inside = substring_matches(wanted.select(F.explode(F.array("a", "b")).alias("needle")), t.select(F.explode(F.array("subject", "object")).alias("hay")))
    ways = t.select(F.col("subject").alias("x"), "predicate", F.col("object").alias("y")).unionByName(t.select(F.col("object").alias("x"), "predicate", F.col("subject").alias("y")))
    known = wanted.join(inside.withColumnsRenamed({"needle": "a", "hay": "x"}), "a").join(ways, "x").join(inside.withColumnsRenamed({"needle": "b", "hay": "y"}), ["b", "y"])
    known = known.groupBy("a", "b").agg(F.min(F.replace("predicate", F.lit(" "), F.lit("_"))).alias("known"))
    out = pairs.withColumn("rule", rule).join(known, ["a", "b"], "left")
    score = F.when((F.col("rule") == "part_of") | (F.col("rule").isNull() & F.col("known").isNotNull()), 0.8).when(F.col("rule").isNotNull(), 0.7)
    return out.withColumn("kind", F.coalesce("rule", "known")).withColumn("confidence", score).drop("rule", "known")


def within_bounds(relations: DataFrame, kind: str, head: str, tail: str, bounds: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Relations whose kind has no bounds, or whose ends' labels are among those its bounds allow; a null label is in no bounds."""
    ok = ~F.col(kind).isin(list(bounds))
    for name, (heads, tails) in bounds.items():
        ok = ok | ((F.col(kind) == name) & F.col(head).isin(heads) & F.col(tail).isin(tails))
    return relations.where(F.coalesce(ok, F.lit(False)))


def merge_relation_sources(ontology: DataFrame, other: DataFrame) -> DataFrame:
    """Ontology relations at 1.1 times their score; others as they are, or at 0.7 if the ontology types the pair differently."""
    strong = ontology.select("head", "tail", "type", (F.col("score") * 1.1).alias("score"), F.lit("ontology").alias("origin"))
    known = ontology.groupBy("head", "tail").agg(F.collect_set("type").alias("types"))
    weak = other.join(known, ["head", "tail"], "left")
    clash = F.col("types").isNotNull() & ~F.array_contains("types", F.col("type"))
    return strong.unionByName(weak.select("head", "tail", "type", F.when(clash, F.col("score") * 0.7).otherwise(F.col("score")).alias("score"), F.lit("text").alias("origin")))


def proximity(text: Column, a: Column, b: Column) -> Column:
    """1 less the distance of first occurrences over the text's length, at least 0; 0 if one does not occur."""
    p, q = F.call_function("instr", text, a), F.call_function("instr", text, b)
    return F.when((p > 0) & (q > 0), F.greatest(F.lit(0.0), 1 - F.abs(p - q) / F.length(text))).otherwise(0.0)


def cooccurrence_matrix(entities: DataFrame, case: str, item: str, weight: str) -> DataFrame:
    """Coordinates (case, i, j, weight) of each case's symmetric matrix, upper half: product of the two weights."""
    e = entities.groupBy(case, item).agg(F.max(weight).alias("w"))
    i, j = e.select(case, F.col(item).alias("i"), F.col("w").alias("wi")), e.select(case, F.col(item).alias("j"), F.col("w").alias("wj"))
    return i.join(j, case).where("i < j").select(case, "i", "j", (F.col("wi") * F.col("wj")).alias("weight"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) by an inverted index; documents that share no word with a query have no row.

    ``docs`` (doc_id, words), ``queries`` (query_id, words). Postings are counted before they meet queries.
    """
    postings = docs.select("doc_id", F.size("words").alias("len"), F.explode("words").alias("word")).groupBy("doc_id", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg_len"))
    df = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    asked = asked.join(df, "word").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return asked.join(postings, "word").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))


def minmax(df: DataFrame, keys: Sequence[str], column: str) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(column) - F.min(column).over(w)) / (F.max(column).over(w) - F.min(column).over(w) + 1e-8)


def hybrid(scores: DataFrame, keys: Sequence[str], dense: str, sparse: str, weight: float = 0.7) -> DataFrame:
    """``scores`` with ``hybrid``: weighted sum of both scores scaled to 0..1 within each key."""
    return scores.withColumn("hybrid", weight * minmax(scores, keys, dense) + (1 - weight) * minmax(scores, keys, sparse))


def concept_lookup(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(mention, concept, score): the equal concept at 1, else the shortest one that holds the mention or is held by it at 0.7; null at 0."""
    m = mentions.where(F.length("mention") > 0).select("mention").distinct()
    c = concepts.where(F.length("term") > 0).select("term").distinct()
    exact = m.join(c.select(F.col("term").alias("mention")), "mention", "left_semi").select("mention", F.col("mention").alias("concept"), F.lit(1.0).alias("score"))
    rest = m.join(exact, "mention", "left_anti")
    inside = substring_matches(rest.select(F.col("mention").alias("needle")), c.select(F.col("term").alias("hay"))).select(F.col("needle").alias("mention"), F.col("hay").alias("term"))
    around = substring_matches(c.select(F.col("term").alias("needle")), rest.select(F.col("mention").alias("hay"))).select(F.col("hay").alias("mention"), F.col("needle").alias("term"))
    near = inside.unionByName(around).groupBy("mention").agg(F.min_by("term", F.struct(F.length("term"), F.col("term"))).alias("concept")).withColumn("score", F.lit(0.7))
    none = rest.join(near, "mention", "left_anti").select("mention", F.lit(None).cast("string").alias("concept"), F.lit(0.0).alias("score"))
    return exact.unionByName(near).unionByName(none)


def part_matches(terms: DataFrame, entities: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(keys, term, parts): multi-word terms with at least ``least`` of their words among a case's entity words."""
    w = _words(terms)
    have = entities.select(*keys, F.explode(F.split("text", " ")).alias("word")).distinct()
    return have.join(w, "word").groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") >= least)


def adjacent_compounds(entities: DataFrame, keys: Sequence[str], order: str, known: DataFrame) -> DataFrame:
    """(keys, compound, score) from neighbours in order: known pairs 0.9, known triples 0.95."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = entities.select(*keys, order, "text", F.lead("text", 1).over(w).alias("t2"), F.lead("text", 2).over(w).alias("t3"))
    two = n.where("t2 IS NOT NULL").select(*keys, F.concat_ws(" ", "text", "t2").alias("compound"), F.lit(0.9).alias("score"))
    three = n.where("t3 IS NOT NULL").select(*keys, F.concat_ws(" ", "text", "t2", "t3").alias("compound"), F.lit(0.95).alias("score"))
    return two.unionByName(three).join(known.select(F.col("term").alias("compound")).distinct(), "compound", "left_semi").select(*keys, "compound", "score").distinct()


def greedy_disjoint(compounds: DataFrame, key: str) -> DataFrame:
    """Compounds of a text taken by falling confidence while their parts are unused; ties by name.

    ``compounds`` (key, compound, confidence, parts). Sequential inside one text, whose group is small.
    """
    typed = dict(compounds.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        keep = []
        for i, row in pdf.sort_values(["confidence", "compound"], ascending=[False, True]).iterrows():
            if not used & set(row["parts"]):
                used |= set(row["parts"])
                keep.append(i)
        return pdf.loc[keep, [key, "compound", "confidence"]]

    return compounds.select(key, "compound", "confidence", "parts").groupBy(key).applyInPandas(one, f"{key} {typed}, compound string, confidence double")


def select_compounds(terms: DataFrame, entities: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, compound, confidence): ``greedy_disjoint`` over ``part_matches``, without a row for each candidate.

    Confidence is the share of a term's distinct words that the case has. Cases are dealt into buckets and
    each meets all terms, whose index by word one task holds; a pick strikes out the terms that share a word.
    """
    typed = dict(entities.dtypes)[key]
    have = entities.select(key, F.explode(F.split("text", " ")).alias("word")).where("word != ''").groupBy(key).agg(F.collect_set("word").alias("words"))
    buckets = max(entities.sparkSession.sparkContext.defaultParallelism, -(-have.count() // 2048))
    cases = have.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    many = _words(terms.select("term").distinct()).groupBy("term").agg(F.collect_list("word").alias("words")).where(F.size("words") >= least)
    every = many.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("term", ignore_index=True)
        size = np.array([len(w) for w in right["words"]], np.float64)
        lists: dict[str, list[int]] = {}
        for i, words in enumerate(right["words"]):
            for w in words:
                lists.setdefault(w, []).append(i)
        index = {w: np.array(x) for w, x in lists.items()}
        rows = []
        for case, words in zip(left[key], left["words"]):
            hit = [index[w] for w in words if w in index]
            if not hit:
                continue
            n = np.bincount(np.concatenate(hit), minlength=len(size))
            score = np.where(n >= least, n / size, -1.0)
            while score[i := int(score.argmax())] > 0:  # of equal scores the first by name
                rows.append((case, right["term"][i], score[i]))
                for w in right["words"][i]:
                    score[index[w]] = -1.0
        return pd.DataFrame(rows, columns=[key, "compound", "confidence"])

    return cases.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInPandas(run, f"{key} {typed}, compound string, confidence double")


def replace_parts(entities: DataFrame, compounds: DataFrame, key: str) -> DataFrame:
    """(key, text): compounds in place of the entities that are their parts; other entities stay."""
    parts = compounds.select(key, F.explode("parts").alias("text"))
    return entities.select(key, "text").join(parts, [key, "text"], "left_anti").union(compounds.select(key, F.col("compound").alias("text"))).distinct()


def merge_by_concept(entities: DataFrame, key: str) -> DataFrame:
    """(key, concept, merged, n): a case's entities of one concept as one sorted phrase."""
    return entities.groupBy(key, "concept").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("text", " "))))), " ").alias("merged"), F.count(F.lit(1)).alias("n"))


def graph_rerank(candidates: DataFrame, similarity: str, graph: str, weight: float = 0.6) -> DataFrame:
    """``candidates`` with ``final``: weighted likeness and graph score; a missing graph score counts 0.1."""
    return candidates.withColumn("final", weight * F.col(similarity) + (1 - weight) * F.coalesce(graph, F.lit(0.1)))
