from corvigraph.llm import mixing as M

TARGETS = "source string, target_share double, max_uses int"


def tables(spark):
    docs = [(i, "x" * 99, "big") for i in range(2000)] + [(10_000 + i, "x" * 99, s) for i, s in enumerate(["Small-Src", " small src", "SMALL_SRC "] * 100)]
    docs += [(20_000, None, "big"), (20_001, "abc", None), (20_002, "abc", "other"), (20_003, "", "tiny")]
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, source string, tokens int, key string")
    return d, spark.createDataFrame([("big", 0.6, 2), ("small_src", 0.3, 3), ("tiny", 0.05, 5), ("none", 0.05, 9)], TARGETS)


def test_rates_and_shares(spark):
    d, t = tables(spark)
    r = {x.source: x for x in M.source_rates(d, t).collect()}
    total = 2300 * 100 + 1
    assert {s: (x.documents, x.tokens, x.total) for s, x in r.items()} == {"big": (2000, 200_000, total), "small_src": (300, 30_000, total), "tiny": (1, 1, total), "none": (0, 0, total)}
    assert {s for s, x in r.items() if not x.reachable} == {"tiny", "none"}
    assert r["tiny"].rate == 5 and r["none"].rate == 0
    assert abs(sum(x.rate * x.tokens for x in r.values()) - total) < 1
    assert abs(r["big"].rate * 200_000 / (r["small_src"].rate * 30_000) - 2) < 1e-9
    shares = {x.source: x.share for x in M.mix_shares(d, t).collect()}
    assert abs(shares["big"] - 0.667) < 0.02 and abs(shares["small_src"] - 0.333) < 0.02


def test_uses_are_capped_whole_and_repeatable(spark):
    d, t = tables(spark)
    uses = [(r.doc_id, r.source, r.uses) for r in M.document_uses(d, t).orderBy("doc_id").collect()]
    assert len(uses) == 2301 and uses == [(r.doc_id, r.source, r.uses) for r in M.document_uses(d.repartition(7), t).orderBy("doc_id").collect()]
    rates = {x.source: x for x in M.source_rates(d, t).collect()}
    assert all(int(rates[s].rate) <= u <= min(int(rates[s].rate) + 1, rates[s].max_uses) for _, s, u in uses)


def test_all_sources_capped(spark):
    d = spark.createDataFrame([(1, "abc", "a"), (2, "abc", "b")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 1)], TARGETS)
    assert {x.source: round(x.rate, 9) for x in M.source_rates(d, t).collect()} == {"a": 1.0, "b": 1.0}


def test_empty(spark):
    d, t = tables(spark)
    assert M.document_uses(d.limit(0), t).count() == 0 and M.document_uses(d, t.limit(0)).count() == 0
    assert {x.rate for x in M.source_rates(d.limit(0), t).collect()} == {0.0}


def test_no_target_and_unreachable_by_emission(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        names = [f"s{i}" for i in range(6)]
        docs = [(i, "x" * rng.randrange(1, 400), rng.choice(names[:5])) for i in range(60)]
        rows = [(n, rng.choice([0.0, 0.05, 0.1, 0.3, 0.6]), rng.choice([1, 1, 2, 4])) for n in names] + [("null", None, None)]
        d, t = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(rows, TARGETS)
        size = {n: sum(len(x) + 1 for _, x, s in docs if s == n) for n in names}
        total = sum(size.values())
        want = {n for n, share, most in rows[:-1] if most * size[n] < share * total}
        assert {r.source for r in M.unreachable(d, t).collect()} == want
        rates = {r.source: r.rate for r in M.source_rates(d, t).collect()}
        assert all(rates[n] == 0 for n, share, _ in rows if not share)
