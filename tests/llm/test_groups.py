import random

from corvigraph.llm import groups
from corvigraph.llm.queries import name_links
from corvigraph.plans.scratch import Scratch


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(find(x), x) for x in up}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)]
    links += [(f"chain{i:03}", f"chain{i + 1:03}") for i in range(70)] + [("hub", f"leaf{i}") for i in range(120)]
    links += [("self", "self"), ("n1", None), (None, None), links[0]]
    df = spark.createDataFrame(links, "x string, y string")
    assert {tuple(r) for r in groups.named_groups(df, Scratch(spark, "t")).collect()} == brute(links)


def test_empty(spark):
    assert groups.named_groups(spark.createDataFrame([], "x string, y string"), Scratch(spark, "t")).count() == 0


def test_entries_without_a_name_link_nothing(spark):
    entry = lambda n: {"type": "t", "name": n}
    maps = [({"a": entry("B"), "c": None, "d": entry(None), "e": entry(" "), "f": entry("Unknown"), "g": entry("n/a"), "h": entry("?"), " ": entry("x")},), ({},), (None,)]
    df = spark.createDataFrame(maps, "entity_map map<string,struct<type:string,name:string>>")
    assert [tuple(r) for r in name_links(df).collect()] == [("a", "b")]


def test_a_star_of_a_hundred_thousand_and_a_chain(spark):
    star = spark.range(100_000).selectExpr("'hub' AS x", "concat('leaf', id) AS y")
    chain = spark.range(300).selectExpr("concat('n', lpad(id, 4, '0')) AS x", "concat('n', lpad(id + 1, 4, '0')) AS y")
    got = groups.named_groups(star.union(chain), Scratch(spark, "t"), least=5_000)
    assert {(r.group_name, r["count"]) for r in got.groupBy("group_name").count().collect()} == {("hub", 100_001), ("n0000", 301)}


def test_ranks_follow_the_order_of_names(spark):
    names = [f"n{i * 7919 % 1000}" for i in range(1000)] + ["é", "Z", ""]
    got = groups.ranked(spark.createDataFrame([(n,) for n in names], "name string"), Scratch(spark, "t")).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.id)] == sorted(names, key=str.encode) and {r.id for r in got} == set(range(len(names)))
