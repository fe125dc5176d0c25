import random

import numpy as np
import pytest

from corvigraph.llm import packing as P
from corvigraph.plans.scratch import Scratch


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, container string, part int, tokens int")


def test_nothing_is_lost_or_split_needlessly(spark):
    rng = random.Random(6)
    texts = ["é" * rng.randrange(0, 70) for _ in range(400)] + ["x" * 500, "日本" * 90, "", None, "y" * 99, "y" * 100]
    df = documents(spark, texts)
    pieces = P.sized_pieces(df, 100)
    for per in (20, 10_000):
        placed, report = P.pack(pieces, Scratch(spark, "t"), 100, per)
        rows = placed.collect()
        fill, places = {}, {}
        for r in rows:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            places.setdefault(r.container, []).append(r.place)
        assert max(fill.values()) <= 100 and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
        assert all(r.fill == fill[r.container] for r in rows)
        whole = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.piece_no)):
            whole.setdefault(r.doc_id, b"")
            whole[r.doc_id] += texts[r.doc_id].encode()[r.first_byte : r.first_byte + r.bytes]
        assert {i: b.decode() for i, b in whole.items()} == {i: t for i, t in enumerate(texts) if t is not None}
        assert all((r.piece_no == 1) or len(texts[r.doc_id].encode()) + 1 > 100 for r in rows)
        total = sum(len(t.encode()) + 1 for t in texts if t is not None)
        assert sum(fill.values()) == total
        bound = P.lower_bound(np.array([r.tokens for r in rows]), 100)
        assert bound <= len(fill) <= bound + (1 if per > len(texts) else 0.04 * bound)  # partitions of 20 pieces leave some space
        assert report.count() >= 1


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(7)
    for _ in range(200):
        sizes = rng.integers(1, 51, rng.integers(1, 40))
        bins = P.best_fit_decreasing(sizes, 50)
        assert max(np.bincount(bins, weights=sizes)) <= 50
        assert -(-sizes.sum() // 50) <= P.lower_bound(sizes, 50) <= bins.max() + 1
    assert P.lower_bound(np.array([26, 26, 26]), 50) == 3 and P.lower_bound(np.array([], int), 50) == 0
    assert P.lower_bound(np.array([18] * 6), 50) == 3


def test_empty_and_bad_capacity(spark):
    empty = documents(spark, ["a"]).limit(0)
    assert P.pack(P.sized_pieces(empty), Scratch(spark, "t"))[0].count() == 0
    with pytest.raises(ValueError):
        P.sized_pieces(empty, 3)


def test_exchange_saves_containers_and_keeps_partitions_bounded(spark):
    rng = random.Random(9)
    df = documents(spark, ["x" * rng.choice([34, 35, 26, 48, 51, 20, 66]) for _ in range(1_500)])
    pieces = P.sized_pieces(df, 100)
    placed, report = P.pack(pieces, Scratch(spark, "t"), 100, 100)
    rows = report.collect()
    assert max(r.round for r in rows) >= 1 and max(r["items"] for r in rows) < 200
    first, closed = sum(r.used for r in rows if r.round == 0), placed.select("container").distinct().count()
    bound = P.whole_bound(pieces, 100)
    assert bound <= closed <= first and placed.count() == 1_500
    assert bound == P.lower_bound(np.array([r.tokens for r in pieces.collect()]), 100)
