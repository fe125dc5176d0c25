from corvigraph.plans import skew


def test_spread_join_equals_a_plain_join(spark):
    rows = [("hub", i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(100)] + [(None, 1), ("lost", 2)]
    many = spark.createDataFrame(rows, "k string, v int")
    table = spark.createDataFrame([("hub", 1)] + [(f"k{i}", i) for i in range(60)] + [(None, 9)], "k string, w int")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(table, ["k"], how).collect()))
        for least in (7, 50, 10_000):
            assert sorted(map(str, skew.spread_join(many, table, ["k"], how, least).select("k", "v", "w").collect())) == want
    assert [(r.k, r._salts) for r in skew.hot_keys(many, ["k"], 50).collect()] == [("hub", 6)]
    assert skew.spread_join(many.limit(0), table, ["k"], least=0).count() == 0
