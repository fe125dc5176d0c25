"""Compound terms of cases: candidates, their scores, their choice, and the merging of entities by them.

Cases are (case_id, text); their entities (case_id, t), lower case and distinct. No step pairs all entities
of a case: candidates come from terms that hold one another, and from classes of terms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import any_contains
from ..plans.scratch import Scratch
from .graph import components
from .ontology import proximity, substring_matches

STOP_WORDS = ["and", "for", "of", "or", "the"]
CASE, TERM = "case_id", "t"


def _words(c: str) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _with_parts(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, compound, parts, hits) of ``found`` (case_id, compounds): the case's entities that hold one of a compound's words, and how often one holds one.

    A compound meets its own case's entities only: a word like "of" stands in most terms of the vocabulary.
    """
    own = entities.groupBy(CASE).agg(F.collect_set(TERM).alias("own"))
    rows = found.join(own, CASE).select(CASE, "own", F.explode(F.transform("compounds", lambda c: F.struct(c.alias("compound"), _words(c).alias("words")))).alias("c"))
    held = rows.select(CASE, "c.compound", F.transform("own", lambda t: F.struct(t.alias("t"), F.size(F.filter(F.col("c.words"), lambda w: F.contains(t, w))).alias("n"))).alias("held"))
    some = held.select(CASE, "compound", F.filter("held", lambda x: x["n"] > 0).alias("held"))
    return some.select(CASE, "compound", F.array_sort(F.col("held.t")).alias("parts"), F.aggregate("held.n", F.lit(0), lambda s, n: s + n).alias("hits"))


def _compounds_of(entities: DataFrame, keyed: DataFrame) -> DataFrame:
    """(case_id, compounds): the distinct compounds that ``keyed`` (t, compound) has for a case's entities."""
    lists = keyed.groupBy(TERM).agg(F.collect_set("compound").alias("found"))  # as lists, so that a frequent entity makes no row per compound
    return entities.select(CASE, TERM).join(lists, TERM).groupBy(CASE).agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("compounds"))


def direct_candidates(cases: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compounds (of ``pairs``: parent, child) whose parent is an entity and that stand in the case's text: 0.9."""
    p = pairs.where((F.length("parent") > 2) & (F.length("child") > F.length("parent"))).select(F.col("parent").alias(TERM), F.col("child").alias("compound")).distinct()
    near = _compounds_of(entities, p).join(cases.select(CASE, F.lower("text").alias("low")), CASE)
    hit = near.select(CASE, F.filter("compounds", lambda c: F.contains(F.col("low"), c)).alias("compounds")).where(F.size("compounds") > 0)
    return _with_parts(hit, entities).select(CASE, "compound", F.lit("hierarchical_direct").alias("method"), F.lit(0.9).alias("confidence"), "parts")


def pattern_candidates(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of several words of which an entity is one, and whose words stand at least twice in entities of the case: 0.8."""
    many = terms.where((F.size(_words("term")) > 1) & (F.length("term") > 5)).select(F.col("term").alias("compound")).distinct()
    keyed = many.select("compound", F.explode(F.array_distinct(_words("compound"))).alias(TERM)).where((F.length(TERM) > 2) & ~F.col(TERM).isin(STOP_WORDS))
    return _with_parts(_compounds_of(entities, keyed), entities).where("hits >= 2").select(CASE, "compound", F.lit("medical_pattern").alias("method"), F.lit(0.8).alias("confidence"), "parts")


def context_candidates(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Disease and vaccine where something is prevented, condition and medication where it is treated (0.85), anatomy and finding (0.9)."""
    low = F.lower("text")
    rules = [
        ("disease", "vaccine", any_contains(low, ["prevention", "prevent", "against"]), 0.85, "context_vaccine_disease"),
        ("condition", "medication", any_contains(low, ["treatment", "manage", "for"]), 0.85, "context_condition_medication"),
        ("anatomy", "finding", F.lit(True), 0.9, "context_anatomy_finding"),
    ]
    out = None
    for one, two, context, confidence, name in rules:
        a = entities.where(T.has_test(F.col(TERM), one)).select(CASE, F.col(TERM).alias("a"))
        b = entities.where(T.has_test(F.col(TERM), two)).select(CASE, F.col(TERM).alias("b"))
        part = a.join(b, CASE).join(cases.where(context).select(CASE), CASE).select(CASE, F.concat_ws(" ", "a", "b").alias("compound"), F.lit(name).alias("method"), F.lit(confidence).alias("confidence"), F.array_sort(F.array_distinct(F.array("a", "b"))).alias("parts"))
        out = part if out is None else out.unionByName(part)
    return out


def candidates(cases: DataFrame, entities: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, compound, method, confidence, parts) by all three ways."""
    return direct_candidates(cases, entities, pairs).unionByName(pattern_candidates(entities, terms)).unionByName(context_candidates(cases, entities)).distinct()


def similar_candidates(found: DataFrame, cases: DataFrame, top: int = 20) -> DataFrame:
    """``found`` with ``similarity``, the TF-IDF cosine of compound and text within the case, and ``rank``; the ``top`` best of each case.

    Documents of a case are its text and its candidates; words are runs of two or more letters or digits;
    the inverse frequency is ln((1 + n) / (1 + df)) + 1.
    """
    tokens = lambda c: F.expr(rf"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)")
    docs = found.select(CASE, F.col("compound").alias("doc"), "method", tokens("compound").alias("words"))
    count = found.groupBy(CASE).agg((F.count(F.lit(1)) + 1).alias("n"))
    texts = cases.join(count, CASE).select(CASE, "n", F.explode(tokens("text")).alias("word")).groupBy(CASE, "n", "word").agg(F.count(F.lit(1)).alias("tf_text"))
    terms = docs.select(CASE, "doc", "method", F.explode("words").alias("word")).groupBy(CASE, "doc", "method", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy(CASE, "word").agg(F.count(F.lit(1)).alias("df"))
    in_text = texts.join(df, [CASE, "word"], "left").withColumn("idf", F.log((1 + F.col("n")) / (2 + F.coalesce("df", F.lit(0)))) + 1)
    norm_text = in_text.groupBy(CASE).agg(F.sqrt(F.sum((F.col("tf_text") * F.col("idf")) ** 2)).alias("norm_text"))
    weighted = terms.join(df, [CASE, "word"]).join(count, CASE).join(texts.select(CASE, "word", "tf_text"), [CASE, "word"], "left")
    idf = F.log((1 + F.col("n")) / (1 + F.col("df") + F.when(F.col("tf_text").isNotNull(), 1).otherwise(0))) + 1
    dots = weighted.groupBy(CASE, "doc", "method").agg(F.sum(F.coalesce("tf_text", F.lit(0)) * F.col("tf") * idf * idf).alias("dot"), F.sqrt(F.sum((F.col("tf") * idf) ** 2)).alias("norm"))
    sim = dots.join(norm_text, CASE, "left").select(CASE, F.col("doc").alias("compound"), "method", F.coalesce(F.try_divide("dot", F.col("norm") * F.col("norm_text")), F.lit(0.0)).alias("similarity"))
    scored = found.join(sim, [CASE, "compound", "method"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    w = Window.partitionBy(CASE).orderBy(F.desc(F.round("similarity", 9)), "compound", "method")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def graph_score(text: Column, compound: Column, method: Column) -> Column:
    """0.3, and 0.3 if the compound stands in the text, 0.2 or 0.15 by method, 0.1 for three words and 0.05 for two; at most 1."""
    words = F.size(F.filter(F.split(compound, " "), lambda w: w != ""))
    score = 0.3 + F.when(F.contains(F.lower(text), compound), 0.3).otherwise(0.0)
    score = score + F.when(method == "hierarchical_direct", 0.2).when(method == "snomed_exact", 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(words >= 3, 0.1).when(words >= 2, 0.05).otherwise(0.0))


def resolve_by_rules(scored: DataFrame, most: int = 3) -> DataFrame:
    """Candidates (with combined and graph_score) of combined above 0.5 or graph score above 0.3, the best ``most`` of each case."""
    w = Window.partitionBy(CASE).orderBy(F.desc(F.round("combined", 9)), "compound", "method")
    ok = scored.where((F.col("combined") > 0.5) | (F.col("graph_score") > 0.3))
    return ok.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def best_of_blocks(similar: DataFrame, cases: DataFrame, least: float = 0.8) -> DataFrame:
    """(case_id, compound, method, score): candidates more alike than ``least`` form a block, in the order of their rank, and the best of each stays.

    The score is 0.4 of the similarity, 0.3 or 0.2 by method, 0.2 if the compound has no more words than the
    text, and 0.1 for each part where there are several. A group is one case's candidates, at most 20.
    """
    import numpy as np

    typed = dict(similar.dtypes)[CASE]
    held = similar.join(cases.select(CASE, F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("text_words")), CASE)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import re

        pdf = pdf.sort_values("rank").reset_index(drop=True)
        docs = [re.findall(r"\w\w+", c.lower()) for c in pdf["compound"]]
        names = sorted({w for d in docs for w in d})
        tf = np.array([[d.count(w) for w in names] for d in docs], float).reshape(len(docs), len(names))
        v = tf * (np.log((1 + len(docs)) / (1 + (tf > 0).sum(0))) + 1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        alike, used, keep = v @ v.T, set(), []
        parts = pdf["parts"].map(len)
        score = 0.4 * pdf["similarity"] + pdf["method"].map({"hierarchical_direct": 0.3, "medical_pattern": 0.2}).fillna(0.0)
        score += 0.2 * (pdf["compound"].str.split().map(len) <= pdf["text_words"]) + np.where(parts > 1, 0.1 * parts, 0.0)
        for i in range(len(pdf)):
            if i not in used:
                block = [i, *[j for j in range(len(pdf)) if j not in used and j != i and alike[i, j] > least]]
                used.update(block)
                keep.append(max(block, key=lambda j: (score[j], -j)))
        return pdf.loc[keep, [CASE, "compound", "method"]].assign(score=score[keep].round(9))

    return held.groupBy(CASE).applyInPandas(one, f"{CASE} {typed}, compound string, method string, score double")


def matrix_scores(cases: DataFrame, entities: DataFrame, triples: DataFrame, bar: float | None = None) -> DataFrame:
    """(case_id, i, j, compound, local, overall, ontology, combined), i < j: the weighted sum of four matrices for entities of which one holds the other.

    0.4 compound (0.9 for medical compounds, else 0.6) + 0.3 local (product of the scores of entities of one
    section) + 0.2 overall (nearness in the text) + 0.1 ontology (triples between them, each at a hundredth of
    its predicate's number, at most 1). Where none holds the other, the sum is at most 0.6, below any bar for
    merging, so such pairs are not made; with ``bar`` neither are pairs that no triples could bring above it.
    ``entities`` has score and section; ``triples`` subject, predicate, object.
    """
    one = entities.groupBy(CASE, TERM).agg(F.collect_set("section").alias("sections"), F.max("score").alias("w"))
    terms = one.select(TERM).distinct()
    held = substring_matches(terms.select(F.col(TERM).alias("needle")), terms.select(F.col(TERM).alias("hay"))).where("needle != hay")
    left = one.select(CASE, F.col(TERM).alias("needle"), F.col("sections").alias("s1"), F.col("w").alias("w1"))
    right = one.select(CASE, F.col(TERM).alias("hay"), F.col("sections").alias("s2"), F.col("w").alias("w2"))
    pairs = left.join(held, "needle").join(right, [CASE, "hay"])
    weight = F.when(any_contains(F.concat_ws(" ", "needle", "hay"), T.COMPOUND_WORDS), 0.9).otherwise(0.6)
    pairs = pairs.join(cases, CASE, "left").select(CASE, "needle", "hay", weight.alias("compound"), F.when(F.arrays_overlap("s1", "s2"), F.col("w1") * F.col("w2")).otherwise(0.0).alias("local"), F.coalesce(proximity(F.lower("text"), F.col("needle"), F.col("hay")), F.lit(0.0)).alias("overall"))
    plain = 0.4 * F.col("compound") + 0.3 * F.col("local") + 0.2 * F.col("overall")
    if bar is not None:
        pairs = pairs.where(plain + 0.1 > bar)  # the ontology matrix has at most 1
    t = triples.where("subject IS NOT NULL AND object IS NOT NULL").select("subject", "predicate", "object").distinct()
    t = t.join(t.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")), "predicate").select("subject", "object", F.least(F.col("n") / 100, F.lit(1.0)).alias("share"))
    ends = t.select(F.explode(F.array("subject", "object")).alias("hay")).distinct()
    wanted = pairs.select("needle", "hay").distinct()
    inside = substring_matches(wanted.select(F.explode(F.array("needle", "hay")).alias("needle")), ends)
    a, b = inside.select("needle", F.col("hay").alias("x")), inside.select(F.col("needle").alias("hay"), F.col("hay").alias("y"))
    both = t.select(F.col("subject").alias("x"), F.col("object").alias("y"), "share", F.lit(1).alias("way")).unionByName(t.select(F.col("object").alias("x"), F.col("subject").alias("y"), "share", F.lit(2).alias("way")))
    hits = wanted.join(a, "needle").join(both, "x").join(b, ["hay", "y"])
    hits = hits.select("needle", "hay", F.when(F.col("way") == 1, F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("triple"), "share").distinct()  # a triple that fits both ways counts once
    ontology = hits.groupBy("needle", "hay").agg(F.least(F.sum("share"), F.lit(1.0)).alias("ontology"))
    out = pairs.join(ontology, ["needle", "hay"], "left").withColumn("ontology", F.coalesce("ontology", F.lit(0.0)))
    combined = plain + 0.1 * F.col("ontology")
    return out.select(CASE, F.least("needle", "hay").alias("i"), F.greatest("needle", "hay").alias("j"), "compound", "local", "overall", "ontology", combined.alias("combined"))


def merge_by_matrix(scores: DataFrame, scratch: Scratch, bar: float = 0.7) -> DataFrame:
    """(case_id, t, merged): entities linked by a combined score above ``bar``, directly or through others, under one phrase of all of them."""
    links = scores.where(F.col("combined") > bar).select(CASE, F.col("i").alias("src"), F.col("j").alias("dst"))
    parts = scratch.cut(components(links, scratch, [CASE]), "parts")
    phrase = parts.groupBy(CASE, "component").agg(F.array_join(F.array_sort(F.collect_list("id")), " + ").alias("merged"))
    return parts.join(phrase, [CASE, "component"]).select(CASE, F.col("id").alias(TERM), "merged")


def merge_cascade(cases: DataFrame, entities: DataFrame, found: DataFrame, merged: DataFrame) -> DataFrame:
    """(case_id, merged, rule): compounds above 0.6, then matrix merges, then vaccines for diseases and medications for conditions, then what is left.

    An entity that a rule has used up takes no part in later ones. ``found`` are compound candidates, ``merged``
    what :func:`merge_by_matrix` gives.
    """
    strong = found.where("confidence > 0.6").select(CASE, "compound").distinct()
    words = strong.select(CASE, F.explode(_words("compound")).alias("word")).groupBy(CASE).agg(F.collect_set("word").alias("words"))
    used = F.coalesce(F.exists("words", lambda w: F.contains(F.col(TERM), w)), F.lit(False))  # by the words of its own case
    left = entities.select(CASE, TERM).distinct().join(words, CASE, "left").where(~used).select(CASE, TERM)
    linked = left.join(merged, [CASE, TERM])
    left = left.join(linked.select(CASE, TERM), [CASE, TERM], "left_anti")
    kinds = {"vaccine": ["vaccine", "vaccination", "immunization"], "disease": ["disease", "infection", "virus"], "medication": ["medication", "drug", "medicine"], "condition": ["condition", "disorder", "syndrome"]}
    typed = left.withColumn("kind", T.first_class(F.col(TERM), kinds, "none")).join(cases.select(CASE, F.lower("text").alias("low")), CASE, "left")
    rules = [("vaccine", "disease", ["prevent", "against", "protect"]), ("medication", "condition", ["treat", "for", "manage"])]
    clinical = None
    for one, two, cues in rules:
        a = typed.where((F.col("kind") == one) & any_contains(F.col("low"), cues)).select(CASE, F.col(TERM).alias("a"))
        b = typed.where(F.col("kind") == two).select(CASE, F.col(TERM).alias("b"))
        pair = a.join(b, CASE)
        clinical = pair if clinical is None else clinical.unionByName(pair)
    rest = left.join(clinical.select(CASE, F.explode(F.array("a", "b")).alias(TERM)).distinct(), [CASE, TERM], "left_anti")
    out = strong.select(CASE, F.col("compound").alias("merged"), F.lit("compound").alias("rule"))
    out = out.unionByName(linked.select(CASE, "merged", F.lit("matrix").alias("rule")))
    out = out.unionByName(clinical.select(CASE, F.concat("a", F.lit(" for "), "b").alias("merged"), F.lit("clinical").alias("rule")))
    return out.unionByName(rest.select(CASE, F.col(TERM).alias("merged"), F.lit("kept").alias("rule"))).distinct()


#: Concepts whose index one task of linked_entities holds, and entities it takes at a time.
INDEXED, ASKED = 50_000, 10_000


def linked_entities(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """(t, concept, link, retrieval, score): the best concept of each entity by link x retrieval; none where no concept is linked.

    link is 1 for the equal concept, 0.8 where one holds the other, 0.6 where the concept holds a word (of
    more than two signs) of the entity; retrieval is their shared distinct words over the root of the product
    of their numbers. Ties go to the shorter, then the larger concept. Entities meet concepts in blocks by an
    index of words, with a row for the best of a block only: words like "the" link most of both.
    """
    t = entities.where(F.length(TERM) > 0).select(TERM).distinct()
    c = concepts.where(F.length("term") > 0).select("term").distinct()
    rows, cols = max(2 * t.sparkSession.sparkContext.defaultParallelism, -(-t.count() // ASKED)), max(1, -(-c.count() // INDEXED))
    left = t.select(TERM, F.pmod(F.xxhash64(TERM), F.lit(rows)).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    right = c.select("term", F.pmod(F.xxhash64("term"), F.lit(cols)).cast("int").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    scored = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(_linked_block, f"{TERM} string, term string, link double, retrieval double").withColumn("score", F.col("link") * F.col("retrieval"))
    best = scored.groupBy(TERM).agg(F.max_by(F.struct("term", "link", "retrieval", "score"), F.struct(F.round("score", 9), -F.length("term"), F.col("term"))).alias("b"))
    return best.select(TERM, F.col("b.term").alias("concept"), "b.link", "b.retrieval", "b.score")


def _linked_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best concept of a block for each entity of a block, exact."""
    import numpy as np

    terms = sorted(sorted(right["term"], reverse=True), key=len)  # of equal scores the first
    place = {term: i for i, term in enumerate(terms)}
    lengths = sorted({len(x) for x in terms})
    lists: dict[str, list[int]] = {}
    sizes = np.zeros(len(terms))
    for i, term in enumerate(terms):
        words = {w for w in term.split(" ") if w}
        sizes[i] = len(words)
        for w in words:
            lists.setdefault(w, []).append(i)
    index = {w: np.array(x) for w, x in lists.items()}
    joined = "\0".join(terms)
    starts = np.cumsum([0, *[len(x) + 1 for x in terms]])
    split = not any("\0" in x for x in terms)

    def first_with(needle: str) -> int:
        """The first concept that holds a text."""
        if not split or "\0" in needle:
            return next((i for i, x in enumerate(terms) if needle in x), len(terms))
        at = joined.find(needle)
        return len(terms) if at < 0 else int(np.searchsorted(starts, at, "right")) - 1

    def link(t: str, words: list[str], term: str) -> float:
        if t == term:
            return 1.0
        if t in term or term in t:
            return 0.8
        return 0.6 if any(w in term for w in words) else 0.0

    rows = []
    for t in left[TERM]:
        own = {w for w in t.split(" ") if w}
        words = [w for w in own if len(w) > 2]
        hit = [index[w] for w in own if w in index]
        best = None
        if hit:
            n = np.bincount(np.concatenate(hit), minlength=len(terms))
            near = np.flatnonzero(n)
            likeness = n[near].astype(float) / np.sqrt(float(len(own)) * sizes[near])
            for j in np.argsort(-likeness, kind="stable"):
                i, r = int(near[j]), float(likeness[j])
                if best is not None and round(0.8 * r, 9) < best[0]:  # only the equal concept has a link above 0.8, and its likeness is 1
                    break
                k = link(t, words, terms[i])
                if k and (best is None or (round(k * r, 9), -i) > (best[0], -best[1])):
                    best = (round(k * r, 9), i, k, r)
        if best is None:  # no linked concept shares a word with it: the first that is linked
            inside = [place[t[a : a + n]] for n in lengths if n <= len(t) for a in range(len(t) - n + 1) if t[a : a + n] in place]
            i = min([first_with(t), *inside, *[first_with(w) for w in words]])
            if i < len(terms):
                best = (0.0, i, link(t, words, terms[i]), 0.0)
        if best is not None:
            rows.append((t, terms[best[1]], best[2], best[3]))
    return pd.DataFrame(rows, columns=[TERM, "term", "link", "retrieval"])


def metric_scores(found: DataFrame, metrics: DataFrame) -> DataFrame:
    """``found`` with ``graph``: mean of 0.4 PageRank + 0.3 degree + 0.3 betweenness over the vertices that hold the compound or are held by it; 0.1 without any.

    ``metrics`` is (id, pagerank, degree, betweenness).
    """
    c = found.select("compound").distinct()
    v = metrics.select("id").distinct()
    up = substring_matches(c.select(F.col("compound").alias("needle")), v.select(F.col("id").alias("hay"))).select(F.col("needle").alias("compound"), F.col("hay").alias("id"))
    down = substring_matches(v.select(F.col("id").alias("needle")), c.select(F.col("compound").alias("hay"))).select(F.col("hay").alias("compound"), F.col("needle").alias("id"))
    score = 0.4 * F.col("pagerank") + 0.3 * F.col("degree") + 0.3 * F.col("betweenness")
    mean = up.unionByName(down).distinct().join(metrics, "id").groupBy("compound").agg(F.least(F.avg(score), F.lit(1.0)).alias("graph"))
    return found.join(mean, "compound", "left").withColumn("graph", F.coalesce("graph", F.lit(0.1)))


def rerank(scored: DataFrame, cases: DataFrame) -> DataFrame:
    """``scored`` (similarity, graph) with ``final``: 0.6 similarity + 0.4 graph, and 0.3 if in the text, 0.2 if graph is above 0.7, 0.1 if direct."""
    bonus = F.when(F.contains(F.lower("text"), F.col("compound")), 0.3).otherwise(0.0) + F.when(F.col("graph") > 0.7, 0.2).otherwise(0.0) + F.when(F.col("method") == "hierarchical_direct", 0.1).otherwise(0.0)
    return scored.join(cases, CASE).withColumn("final", 0.6 * F.col("similarity") + 0.4 * F.col("graph") + bonus).drop("text")


def replace_by_compounds(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """(case_id, t, replaced): chosen compounds (case_id, compound, parts) in place of their parts; other entities stay."""
    gone = chosen.select(CASE, F.explode("parts").alias(TERM)).distinct()
    kept = entities.select(CASE, TERM).distinct().join(gone, [CASE, TERM], "left_anti").withColumn("replaced", F.lit(False))
    return kept.unionByName(chosen.select(CASE, F.col("compound").alias(TERM), F.lit(True).alias("replaced"))).distinct()
