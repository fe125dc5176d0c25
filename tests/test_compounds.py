import random

import pytest

from corvigraph.operators import compounds as C
from corvigraph.operators import ontology as O  # noqa: E741
from corvigraph.operators import resolution as E
from corvigraph.plans.scratch import Scratch


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_substring_matches_against_brute_force(spark):
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ab é") for _ in range(rng.randrange(0, n)))
    needles, hays = [draw(5) for _ in range(80)] + [None, "", "ab", "ab"], [draw(14) for _ in range(120)] + [None, "", "aba"]
    got = [(r.needle, r.hay) for r in O.substring_matches(column(spark, "needle", needles), column(spark, "hay", hays)).collect()]
    assert sorted(got) == sorted({(n, h) for n in needles for h in hays if n and h and n in h})


def test_heuristic_pairs_of_plain_containment(spark):
    names = ["hip", "ship", "hips", "left hip", "a  b", "c  d", "chip on the left", "ip"]
    bare = lambda t: {w for w in t.split(" ") if w}
    want = sorted((a, b) for a in names for b in names if a < b and (a in b or b in a or (bare(a) & bare(b) and abs(len(a) - len(b)) <= 5)))
    assert sorted((r.a, r.b) for r in E.heuristic_pairs(column(spark, "term", names), whole_words=False).collect()) == want


def test_rule_relations(spark):
    rows = [(1, "vaccine", "rabies virus disease", "given to treat it"), (2, "left hip", "hip", "treat at home"), (3, "a", "b", "to prevent x"), (4, "a", "b", "due to x"), (5, "hip", "left hip", "seen"), (6, "cough", "dog", "seen"), (7, "lung", "ship", "x")]
    pairs = spark.createDataFrame(rows, "id int, a string, b string, text string")
    triples = spark.createDataFrame([("old dog", "part of", "night cough"), ("left hip bone", "is in", "hip joint"), (None, "x", "y")], "subject string, predicate string, object string")
    got = {r.id: (r.kind, r.confidence) for r in O.rule_relations(pairs, triples).collect()}
    assert got == {1: ("treats", 0.7), 2: ("is_in", 0.8), 3: ("prevents", 0.7), 4: ("causes", 0.7), 5: ("part_of", 0.8), 6: ("part_of", 0.8), 7: (None, None)}


CASES = [("c1", "The cat had a rabies vaccine to prevent rabies. Left hip mass."), ("c2", "Medication for a skin condition."), ("c3", None)]
ENTITIES = [("c1", "rabies"), ("c1", "rabies vaccine"), ("c1", "hip"), ("c1", "left side"), ("c1", "mass"), ("c2", "medication"), ("c2", "skin condition"), ("c2", "ear"), ("c3", "hip")]


def tables(spark):
    return spark.createDataFrame(CASES, "case_id string, text string"), spark.createDataFrame(ENTITIES, "case_id string, t string")


def test_candidates_by_three_ways(spark):
    cases, entities = tables(spark)
    pairs = spark.createDataFrame([("hip", "left hip mass"), ("hip", "right hip"), ("mass", "left hip mass")], "parent string, child string")
    got = {(r.case_id, r.compound, r.method): (r.confidence, tuple(r.parts)) for r in C.candidates(cases, entities, pairs, column(spark, "term", ["mass of the left hip", "ear", "hip of none"])).collect()}
    assert got == {
        ("c1", "left hip mass", "hierarchical_direct"): (0.9, ("hip", "left side", "mass")),
        ("c1", "mass of the left hip", "medical_pattern"): (0.8, ("hip", "left side", "mass")),
        ("c1", "rabies rabies vaccine", "context_vaccine_disease"): (0.85, ("rabies", "rabies vaccine")),
        ("c1", "rabies vaccine rabies vaccine", "context_vaccine_disease"): (0.85, ("rabies vaccine",)),
        ("c2", "skin condition medication", "context_condition_medication"): (0.85, ("medication", "skin condition")),
    }


def test_blocks_keep_the_best_and_the_resolver_three(spark):
    cases, _ = tables(spark)
    rows = [("c1", "left hip mass", "hierarchical_direct", 0.9, ["hip", "mass"], 0.7, 1), ("c1", "mass left hip", "medical_pattern", 0.8, ["hip"], 0.7, 2), ("c1", "rabies vaccine", "medical_pattern", 0.8, ["rabies"], 0.2, 3)]
    similar = spark.createDataFrame(rows, "case_id string, compound string, method string, confidence double, parts array<string>, similarity double, rank int")
    got = {r.compound: r.score for r in C.best_of_blocks(similar, cases).collect()}
    assert got == {"left hip mass": round(0.4 * 0.7 + 0.3 + 0.2 + 0.2, 9), "rabies vaccine": round(0.4 * 0.2 + 0.2 + 0.2, 9)}
    scored = spark.createDataFrame([("c", f"x{i}", "m", 0.1 * i, 0.0) for i in range(9)] + [("d", "y", "m", 0.1, 0.4)], "case_id string, compound string, method string, combined double, graph_score double")
    assert {(r.case_id, r.compound) for r in C.resolve_by_rules(scored).collect()} == {("c", "x8"), ("c", "x7"), ("c", "x6"), ("d", "y")}


def test_matrix_merge_and_cascade(spark):
    cases = spark.createDataFrame([("c1", "Drug therapy and drug therapy plan, to treat a skin syndrome."), ("c2", "vaccine against virus x")], "case_id string, text string")
    rows = [("c1", "drug therapy", "findings", 1.0), ("c1", "drug therapy plan", "findings", 1.0), ("c1", "skin syndrome", "findings", 0.5), ("c1", "medicine", "findings", 0.5), ("c1", "ear", "history", 0.5), ("c2", "vaccine", "findings", 0.5), ("c2", "virus x", "findings", 0.5)]
    entities = spark.createDataFrame(rows, "case_id string, t string, section string, score double")
    triples = spark.createDataFrame([(f"s{i}", "p", f"o{i}") for i in range(200)] + [("drug therapy", "p", "a drug therapy plan")], "subject string, predicate string, object string")
    s = C.matrix_scores(cases, entities, triples).collect()
    assert [(r.i, r.j, r.compound, r.local, r.ontology) for r in s] == [("drug therapy", "drug therapy plan", 0.9, 1.0, 1.0)] and s[0].combined > 0.9
    merged = C.merge_by_matrix(C.matrix_scores(cases, entities, triples), Scratch(spark, "t"))
    found = spark.createDataFrame([("c1", "ear canal", "m", 0.8, ["ear"])], "case_id string, compound string, method string, confidence double, parts array<string>")
    got = {tuple(r) for r in C.merge_cascade(cases, entities, found, merged).collect()}
    assert got == {("c1", "ear canal", "compound"), ("c1", "drug therapy + drug therapy plan", "matrix"), ("c1", "medicine for skin syndrome", "clinical"), ("c2", "vaccine for virus x", "clinical")}
    chosen = spark.createDataFrame([("c1", "drug plan", ["drug therapy", "drug therapy plan"])], "case_id string, compound string, parts array<string>")
    assert {tuple(r) for r in C.replace_by_compounds(entities.where("case_id = 'c1'"), chosen).collect()} == {("c1", "drug plan", True), ("c1", "skin syndrome", False), ("c1", "medicine", False), ("c1", "ear", False)}


def test_linked_entities_and_rerank(spark):
    e = spark.createDataFrame([("c", "left hip"), ("c", "hip"), ("c", "old ear"), ("c", "zz")], "case_id string, t string")
    got = {r.t: (r.concept, r.link) for r in C.linked_entities(e, column(spark, "term", ["left hip", "left hip joint", "ears", "ear flap"])).collect()}
    assert got["left hip"] == ("left hip", 1.0) and got["hip"] == ("left hip", 0.8) and got["old ear"] == ("ear flap", 0.6) and "zz" not in got
    found = spark.createDataFrame([("c", "hip", "hierarchical_direct", 0.5), ("c", "nowhere", "m", 0.5)], "case_id string, compound string, method string, similarity double")
    metrics = spark.createDataFrame([("left hip", 1.0, 1.0, 0.5), ("ship", 0.0, 0.5, 0.0)], "id string, pagerank double, degree double, betweenness double")
    cases = spark.createDataFrame([("c", "The hip.")], "case_id string, text string")
    out = {r.compound: (round(r.graph, 9), round(r.final, 9)) for r in C.rerank(C.metric_scores(found, metrics), cases).collect()}
    assert out == {"hip": (0.5, round(0.3 + 0.2 + 0.3 + 0.1, 9)), "nowhere": (0.1, 0.34)}


def test_empty_tables(spark):
    cases, entities = tables(spark)
    pairs = spark.createDataFrame([], "parent string, child string")
    none = C.candidates(cases.limit(0), entities.limit(0), pairs, column(spark, "term", []))
    assert none.count() == 0 and C.similar_candidates(none, cases).count() == 0


def test_index_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    exact = {(r.a, r.b) for r in E.nearest_neighbours(v, "vec_id", "embedding", queries=asked).collect()}
    found = {(r.a, r.b) for r in E.indexed_neighbours(v, asked, "vec_id", "embedding", block=100).collect()}
    assert len(exact) == 5 * asked.count() and len(exact & found) / len(exact) >= 0.9
    n = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.95), (1, 4, 0.7)], "a int, b int, cosine double")
    assert [(r.a, r.b) for r in E.candidate_pairs(n).collect()] == [(1, 2)]
    assert E.indexed_neighbours(v.limit(0), asked, "vec_id", "embedding").count() == 0


def test_linked_entities_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda: " ".join(rng.choice(["the", "of", "hip", "ship", "ear", "ears", "a", "", "left"]) for _ in range(rng.randrange(1, 5))).strip()
    entities, concepts = {draw() for _ in range(60)} - {""}, {draw() for _ in range(60)} - {""} | {"e\nar", "zebra"}

    def brute(t):
        x = {w for w in t.split(" ") if w}
        best = None
        for c in concepts:
            y = {w for w in c.split(" ") if w}
            link = 1.0 if t == c else 0.8 if t in c or c in t else 0.6 if any(len(w) > 2 and w in c for w in x) else 0.0
            if link:
                r = len(x & y) / (len(x) * len(y)) ** 0.5
                best = max(best or (), (round(link * r, 9), -len(c), c, link))
        return best and (best[2], best[3])

    e = spark.createDataFrame([("c", t) for t in entities], "case_id string, t string")
    expected = {t: b for t in entities if (b := brute(t))}
    assert len(expected) > 20
    for size in (50_000, 7):
        monkeypatch.setattr(C, "INDEXED", size)
        out = C.linked_entities(e, column(spark, "term", sorted(concepts)))
        assert {r.t: (r.concept, r.link) for r in out.collect()} == expected
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row per pair that shares "the"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_against_brute_force(spark):
    rng = random.Random(6)
    words = ["of", "ear", "ears", "hip", "x", "skin"]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    own = {f"c{i}": {draw(3) for _ in range(4)} for i in range(25)}
    known = sorted({draw(5) for _ in range(40)} | {"ear  of of", "of hip of skin"})
    texts = {c: " ".join(rng.choice(known) for _ in range(4)).upper() for c in own}
    cases = spark.createDataFrame(list(texts.items()), "case_id string, text string")
    entities = spark.createDataFrame([(c, t) for c, ts in own.items() for t in ts], "case_id string, t string")
    pairs = [(a, b) for a in words for b in known if a in b]
    split = lambda x: [w for w in x.split(" ") if w]
    parts = lambda c, x: [t for t in sorted(own[c]) if any(w in t for w in split(x))]
    direct = {(c, x, tuple(parts(c, x))) for c in own for a, x in pairs if a in own[c] and len(a) > 2 and len(x) > len(a) and x in texts[c].lower()}
    got = C.direct_candidates(cases, entities, spark.createDataFrame(pairs, "parent string, child string"))
    assert sorted((r.case_id, r.compound, tuple(r.parts)) for r in got.collect()) == sorted(direct)
    pattern = {(c, x, tuple(parts(c, x))) for c in own for x in known if len(split(x)) > 1 and len(x) > 5 and any(w in own[c] and len(w) > 2 and w not in C.STOP_WORDS for w in split(x)) and sum(w in t for w in split(x) for t in own[c]) >= 2}
    found = C.pattern_candidates(entities, column(spark, "term", known))
    assert sorted((r.case_id, r.compound, tuple(r.parts)) for r in found.collect()) == sorted(pattern)
    assert len(direct) > 5 and len(pattern) > 20
    assert "gram" not in _plan(got) and "gram" not in _plan(found)  # no word meets the terms of other cases


def test_cascade_uses_the_words_of_the_own_case(spark):
    cases, entities = spark.createDataFrame([("c1", "x"), ("c2", "x")], "case_id string, text string"), spark.createDataFrame([("c1", "hip of dog"), ("c2", "leg of cat"), ("c2", "skin")], "case_id string, t string")
    found = spark.createDataFrame([("c1", "ear of", "m", 0.8, ["ear"]), ("c2", "skin fold", "m", 0.5, ["skin"])], "case_id string, compound string, method string, confidence double, parts array<string>")
    out = C.merge_cascade(cases, entities, found, spark.createDataFrame([], "case_id string, t string, merged string"))
    assert {tuple(r) for r in out.collect()} == {("c1", "ear of", "compound"), ("c2", "leg of cat", "kept"), ("c2", "skin", "kept")}
    assert "gram" not in _plan(out)  # words meet the entities of their own case, not the vocabulary


PREPARED = ["heuristic_graph_scores", "similar_compounds", "compound_resolution", "replaced_entities", "rule_resolver"]


@pytest.mark.parametrize("name", PREPARED)
def test_texts_and_entities_are_written_once(spark, monkeypatch, name):
    from corvigraph.queries import clinical

    labels, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, label="t": labels.append(label) or cut(self, df, label))
    files = getattr(clinical, name)(spark, "/root/testdata/sf0.001").inputFiles()
    assert labels.count("texts") == labels.count("entities") == 1
    assert files and not any("reports_lean" in f or "rag_entities" in f for f in files)


def test_matrix_scores_above_a_bar(spark):
    from corvigraph.queries.clinical import _matrix

    whole = [tuple(r) for r in _matrix(spark, "/root/testdata/sf0.001").collect()]
    above = [tuple(r) for r in _matrix(spark, "/root/testdata/sf0.001", 0.5).collect()]
    assert len(above) < len(whole) and set(above) <= set(whole)
    assert {r for r in whole if r[-1] > 0.5} <= set(above) and any(r[-1] > 0.5 for r in above)
