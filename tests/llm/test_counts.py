import random
from collections import Counter, defaultdict
from itertools import combinations

from corvigraph.llm import pairs, term_counts
from corvigraph.llm.cases import current_rows
from corvigraph.llm.text import normal_form
from corvigraph.plans.scratch import Scratch


def brute(items):
    occurrences, records = Counter(), defaultdict(set)
    for field, record, term in items:
        if not term:
            continue
        words = term.split(" ")
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                g = (field, " ".join(words[i:j]))
                occurrences[g] += 1
                if record is not None:
                    records[g].add(record)
    return {g: (n, len(records[g])) for g, n in occurrences.items()}


def test_ngrams_against_brute_force_over_many_partitions(spark):
    rng = random.Random(1)
    words = ["left", "hip", "mass", "of", "the", "x"]
    items = [("a", f"c{rng.randrange(40)}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for _ in range(600)]
    items += [("a", f"c{i}", "left hip") for i in range(300)] + [("b", "c1", "left hip"), ("b", None, "left hip"), ("b", "c1", None), ("b", "c1", "")]
    df = spark.createDataFrame(items, "field string, record string, term string")
    for per_task in (7, 100, 10**6):
        counts = term_counts.ngram_counts(df, Scratch(spark, "t"), per_task)
        rows = counts.collect()
        plain = {(r.field, r.ngram.replace(term_counts.SEP, " ")): (r.occurrences, r.records) for r in rows if term_counts.BEGIN not in r.ngram and term_counts.END not in r.ngram}
        assert plain == brute(items)
        whole = {(r.field, r.term): (r.occurrences, r.records) for r in term_counts.value_counts(counts).collect()}
        expected = defaultdict(lambda: [0, set()])
        for f, c, t in items:
            if t:
                expected[f, t][0] += 1
                expected[f, t][1] |= {c} - {None}
        assert whole == {k: (n, len(s)) for k, (n, s) in expected.items()}


def test_marks(spark):
    values = spark.createDataFrame([("e", "a", 9, 2), ("e", "b", 9, 3), ("e", "c", 9, 16), ("e", "d", 9, 15)], "field string, term string, occurrences long, records long")
    total = spark.createDataFrame([(100,)], "total long")
    assert {r.term: r.mark for r in term_counts.marked(values, total).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_empty_items(spark):
    assert term_counts.ngram_counts(spark.createDataFrame([], "field string, record string, term string"), Scratch(spark, "t")).count() == 0


ENT = "array<struct<text:string,category:string>>"


def rag(spark, rows):
    from datetime import datetime

    data = [(c, None if t is None else [(x, None) for x in t], n, datetime(2024, 1, d), "extra") for c, t, n, d in rows]
    return spark.createDataFrame(data, f"case_id string, entities {ENT}, num_entities int, processed_at timestamp, terms string")


def test_current_rows(spark):
    df = rag(spark, [("c1", ["A", None, " "], 1, 1), ("c1", ["ｂ  c"], None, 2), ("c1", ["ｂ  c"], None, 2), ("c2", None, 3, 1), (None, ["z"], 1, 1)])
    assert {r.case_id: (r.num_entities, r.terms) for r in current_rows(df).collect()} == {"c1": (None, ["b c"]), "c2": (3, None)}


def test_normal_form():
    assert normal_form("  Ｌeft \n Hip ") == "left hip" and normal_form("  ") is None and normal_form(None) is None


def test_incremental_pairs_equal_a_full_count(spark):
    rng = random.Random(2)
    draw = lambda: [rng.choice("abcdefg") for _ in range(rng.randrange(0, 6))]
    state = pairs.PairTable(Scratch(spark, "t"), buckets=4)
    baskets: dict[int, list | None] = {}
    for batch in range(3):
        change = []
        for b in rng.sample(range(60), 30):
            new = None if batch and rng.random() < 0.2 else draw()
            change.append((baskets.get(b), new))
            baskets[b] = new
        state.apply(spark.createDataFrame(change, "old array<string>, new array<string>"))
    singles, both = Counter(), Counter()
    for items in baskets.values():
        singles.update(set(items or []))
        both.update(combinations(sorted(set(items or [])), 2))
    total = spark.createDataFrame([(60,)], "total long")
    got = {(r.a, r.b): (r.n, r.n_a, r.n_b, round(r.lift, 9)) for r in state.scores(total).collect()}
    assert got == {(a, b): (n, singles[a], singles[b], round(n * 60 / (singles[a] * singles[b]), 9)) for (a, b), n in both.items()}
    hit = spark.createDataFrame([("a",)], "item string")
    assert {(r.a, r.b) for r in state.scores(total, 1, hit).collect()} == {p for p in both if "a" in p}


def test_pairs_of_nothing(spark):
    state = pairs.PairTable(Scratch(spark, "t"))
    state.apply(spark.createDataFrame([(None, None), (None, []), (["a"], ["a", "a", None])], "old array<string>, new array<string>"))
    assert state.scores(spark.createDataFrame([(3,)], "total long")).count() == 0


def test_state_is_opened_again_and_only_the_affected_is_written(spark, tmp_path):
    where, total = f"file://{tmp_path}/state", spark.createDataFrame([(4,)], "total long")
    schema = "old array<string>, new array<string>"
    first = pairs.PairTable(Scratch(spark, "t"), 8, where)
    first.apply(spark.createDataFrame([(None, ["a", "b"]), (None, ["a", "b", "c"]), (None, ["x", "y"]), (None, ["y", "z"])], schema))
    files = dict(first.pairs.state["files"])
    again = pairs.PairTable(Scratch(spark, "t"), 8, where)
    hit = again.apply(spark.createDataFrame([(["x", "y"], ["x", "z"])], schema))
    assert {(r.a, r.b, r.n, r.n_a, r.n_b) for r in hit.collect()} == {("x", "z", 1, 1, 2), ("y", "z", 1, 1, 2)}
    kept = {b for b, w in again.pairs.state["files"].items() if files.get(b) == w}
    assert kept  # buckets of other pairs keep their files
    third = pairs.PairTable(Scratch(spark, "t"), 8, where)
    third.vacuum()
    got = {(r.a, r.b): (r.n, r.n_a, r.n_b) for r in third.scores(total).collect()}
    assert got == {("a", "b"): (2, 2, 2), ("a", "c"): (1, 2, 1), ("b", "c"): (1, 2, 1), ("x", "z"): (1, 1, 2), ("y", "z"): (1, 1, 2)}


def test_buckets_grow(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PER_BUCKET", 5)
    state = pairs.PairTable(Scratch(spark, "t"), 1)
    words = [f"w{i}" for i in range(9)]
    state.apply(spark.createDataFrame([(None, words[:4])], "old array<string>, new array<string>"))
    state.apply(spark.createDataFrame([(words[:4], words)], "old array<string>, new array<string>"))
    assert state.pairs.state["buckets"] == 8 and state.pairs.read().count() == 36 and state.items.read().count() == 9


def test_long_values_are_counted_whole(spark):
    long = " ".join(f"w{i % 7}" for i in range(5_000))
    items = [("a", "c1", long), ("a", "c2", long), ("a", "c2", long), ("a", "c3", long + " x"), ("a", "c3", "w0 w1"), ("a", "c4", " ".join(["w0"] * 4)), ("a", "c5", " ".join(["w0"] * 5))]
    df = spark.createDataFrame(items, "field string, record string, term string")
    for depth in (3, 4, 32):
        for only in (True, False):
            counts = term_counts.ngram_counts(df, Scratch(spark, "t"), 4_000, only, depth)
            whole = {r.term: (r.occurrences, r.records) for r in term_counts.value_counts(counts).collect()}
            assert whole == {long: (3, 2), long + " x": (1, 1), "w0 w1": (1, 1), " ".join(["w0"] * 4): (1, 1), " ".join(["w0"] * 5): (1, 1)}
    plain = {r.ngram.replace(term_counts.SEP, " "): (r.occurrences, r.records) for r in term_counts.ngram_counts(df, Scratch(spark, "t"), 4_000, False, 3).collect() if not set(r.ngram) & {term_counts.BEGIN, term_counts.END}}
    assert plain == {g.replace("_", " "): v for (_, g), v in brute(short_grams(items, 3)).items()}


def short_grams(items, n):
    """Items as single n-grams, so that brute() counts each once: those of up to ``n`` words."""
    out = []
    for f, c, t in items:
        w = t.split(" ")
        for k in range(1, n + 1):
            out += [(f, c, "_".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def test_ngrams_of_any_length(spark, monkeypatch):
    rng = random.Random(3)
    shared = [f"w{rng.randrange(9)}" for _ in range(45)]
    items = [("a", f"c{i % 4}", " ".join([f"x{i}"] * (i % 3) + shared[i % 2 :] + ["y"] * (i % 2))) for i in range(9)]
    items += [("a", "c1", "w1 w2"), ("a", None, " ".join(shared)), ("b", "c1", " ".join(["z"] * 70)), ("b", None, " ".join(f"v{i}" for i in range(36)))]
    df = spark.createDataFrame(items, "field string, record string, term string")
    for run in (16_000_000, 3_000):
        monkeypatch.setattr(term_counts, "RUN", run, raising=False)
        for per_task in (60, 10**6):
            rows = term_counts.ngram_counts(df, Scratch(spark, "t"), per_task).collect()
            plain = {(r.field, r.ngram.replace(term_counts.SEP, " ")): (r.occurrences, r.records) for r in rows if not set(r.ngram) & {term_counts.BEGIN, term_counts.END}}
            assert plain == brute(items)
            assert len(rows) == len({(r.field, r.ngram) for r in rows})


def test_runs_of_a_task():
    import pandas as pd

    blocks = [pd.DataFrame({"suffix": s}) for s in (["a" * 4, "b" * 4], [], ["c" * 30], ["d", "e"])]
    assert [r["suffix"].str[0].tolist() for r in term_counts._runs(iter(blocks), 10)] == [["a", "b"], ["c", "d"], ["e"]]
    assert [len(r) for r in term_counts._runs(iter(blocks), 10**6)] == [5]
    assert list(term_counts._runs(iter(blocks[1:2]), 10)) == []


def test_the_query_gives_long_ngrams(spark, tmp_path):
    from corvigraph.llm.queries import p2_ngrams

    long = " ".join(f"w{i}" for i in range(40))
    rag(spark, [("c1", [long, long], 2, 1), ("c2", [long + " end"], 1, 1)]).write.parquet(f"{tmp_path}/rag_entities.parquet")
    got = {r.ngram: (r.n, r.occurrences, r.cases) for r in p2_ngrams(spark, str(tmp_path)).collect()}
    assert len(got) == 41 * 42 // 2 and got[long] == (40, 3, 2) and got[long + " end"] == (41, 1, 1)
