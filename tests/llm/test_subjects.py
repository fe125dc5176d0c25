import random

from corvigraph.llm import subjects as S
from corvigraph.plans.scratch import Scratch

WORDS = {"law": ["contract", "liability", "plaintiff", "verdict", "appeal"], "sport": ["race", "podium", "sprint", "medal", "hurdle"], "food": ["kibble", "calorie", "ration", "protein", "taurine"]}
FORMS = ["We saw no change in the {}.", "Please compare the {} with the {}.", "Notes on {}: the {} needs attention.", "Questions about {} came up on Monday."]
FILLER = ["Thank you for the visit.", "Staff were informed today.", "The record was updated.", "The race against time was won."]


def corpus(n=600):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(n):
        about = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        sentences = [rng.choice(FORMS).format(*rng.choices(WORDS[s], k=2)) for s in about for _ in range(4)] + rng.choices(FILLER, k=2)
        rng.shuffle(sentences)
        rows.append((i, rng.choice([" ", "\n"]).join(sentences)))
        truth[i] = set(about)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "..."), (9004, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 600, 5) for s in truth[i]], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, s) for s in WORDS], "subject string, description string")
    got = {i: set() for i in range(600)}
    for r in S.subject_counts(docs, areas, labels, Scratch(spark, "t")).where("about * 4 >= sentences").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(600) if i % 5]
    right = sum(got[i] == truth[i] for i in held)
    assert right / len(held) >= 0.9, right / len(held)
    assert not {9001, 9002, 9003} & set(got) and got.get(9004, set()) == got[1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "A contract.")], "doc_id long, text string")
    areas = spark.createDataFrame([("law", "x")], "subject string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert S.subject_counts(docs, areas, none, Scratch(spark, "t")).count() == 0
    assert S.subject_counts(docs.limit(0), areas, none, Scratch(spark, "t")).count() == 0


def test_sentences():
    assert S.sentences("One. Two!\n- Three\r\n\n... ") == ["One.", "Two!", "- Three"]
