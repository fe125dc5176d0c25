import math
import random

from corvigraph.operators import graph as G
from corvigraph.plans.scratch import Scratch


def edges(spark, rows):
    return spark.createDataFrame(rows, "g string, src string, dst string")


def random_graphs(seed=3, graphs=3, n=9, m=16):
    rng = random.Random(seed)
    return [(f"g{k}", f"v{a}", f"v{b}") for k in range(graphs) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} if a != b]


def by_graph(rows):
    out = {}
    for g, a, b in rows:
        out.setdefault(g, set()).add((a, b))
    return out


def bfs(pairs, s):
    near, dist, todo = {}, {s: 0}, [s]
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    count, order, before = {s: 1}, [], {}
    while todo:
        a = todo.pop(0)
        order.append(a)
        for b in near.get(a, []):
            if b not in dist:
                dist[b] = dist[a] + 1
                todo.append(b)
            if dist[b] == dist[a] + 1:
                count[b] = count.get(b, 0) + count[a]
                before.setdefault(b, []).append(a)
    return dist, count, order, before


def test_build_edges_last_wins_no_loops(spark):
    df = spark.createDataFrame([("g", "a", "b", "x", 1), ("g", "a", "b", "y", 2), ("g", "a", "a", "z", 3), ("g", None, "b", "z", 4)], "g string, src string, dst string, kind string, no int")
    assert [(r.src, r.dst, r.kind) for r in G.build_edges(df, ["g"], "no").collect()] == [("a", "b", "y")]


def test_pagerank_sums_to_one_and_equals_power_iteration(spark):
    rows = random_graphs()
    got = {(r.g, r.id): r.rank for r in G.pagerank(edges(spark, rows), Scratch(spark, "t"), ["g"], 12).collect()}
    for g, pairs in by_graph(rows).items():
        nodes = sorted({x for p in pairs for x in p})
        rank = {x: 1 / len(nodes) for x in nodes}
        out = {x: [b for a, b in pairs if a == x] for x in nodes}
        for _ in range(12):
            lost = sum(rank[x] for x in nodes if not out[x])
            rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == x) + lost / len(nodes)) for x in nodes}
        assert all(math.isclose(got[g, x], rank[x], rel_tol=1e-9) for x in nodes) and math.isclose(sum(got[g, x] for x in nodes), 1)


def test_components_of_a_long_chain_and_clusters(spark):
    rows = [("g", f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("g", "x", "y"), ("h", "c000", "z")]
    got = {(r.g, r.id): r.component for r in G.components(edges(spark, rows), Scratch(spark, "t"), ["g"]).collect()}
    assert {got["g", f"c{i:03}"] for i in range(61)} == {"c000"} and got["g", "y"] == "x" and got["h", "z"] == "c000"


def test_paths_closeness_and_betweenness_against_bfs(spark):
    rows = random_graphs(5)
    e = edges(spark, rows)
    paths = G.shortest_paths(e, Scratch(spark, "t"), ["g"])
    got = {(r.g, r.source, r.target): r.distance for r in paths.collect()}
    close = {(r.g, r.id): r.closeness for r in G.closeness(paths, G.vertices_of(e, ["g"]), ["g"]).collect()}
    between = {(r.g, r.id): r.betweenness for r in G.betweenness(e, Scratch(spark, "t"), ["g"]).collect()}
    for g, pairs in by_graph(rows).items():
        nodes = sorted({x for p in pairs for x in p})
        n, score = len(nodes), dict.fromkeys(nodes, 0.0)
        found = {s: bfs(pairs, s) for s in nodes}
        for s, (dist, count, order, before) in found.items():
            assert {t: d for (k, a, t), d in got.items() if (k, a) == (g, s)} == dist
            delta = dict.fromkeys(nodes, 0.0)
            for w in reversed(order):
                for v in before.get(w, []):
                    delta[v] += count[v] / count[w] * (1 + delta[w])
                if w != s:
                    score[w] += delta[w]
        for x in nodes:
            assert math.isclose(between[g, x], score[x] / ((n - 1) * (n - 2)), abs_tol=1e-12)
            far = [d[0][x] for s, d in found.items() if s != x and x in d[0]]
            assert math.isclose(close[g, x], len(far) / sum(far) * len(far) / (n - 1) if far else 0, abs_tol=1e-12)


def test_triangles_and_scores(spark):
    e = edges(spark, [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "d"), ("g", "d", "c")])
    assert [tuple(r) for r in G.triangles(e, ["g"]).collect()] == [("g", "a", "b", "c")]
    assert {r.id: r.clustering for r in G.clustering_coefficient(e, ["g"]).collect()} == {"a": 1.0, "b": 1.0, "c": 1 / 3, "d": 0.0}
    s = {(r.a, r.b): r.common for r in G.neighbour_scores(e, ["g"]).collect()}
    assert s == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("a", "d"): 1, ("b", "d"): 1}


def test_modularity_and_cycles(spark):
    e = edges(spark, [("g", a, b) for c in ("abc", "xyz") for a in c for b in c if a < b] + [("g", "c", "x")])
    got = {r.id: r.community for r in G.modularity_communities(e, ["g"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert G.cyclic_vertices(e, Scratch(spark, "t"), ["g"]).count() == 0
    loop = edges(spark, [("g", "a", "b"), ("g", "b", "a"), ("g", "b", "c")])
    assert {r.id for r in G.cyclic_vertices(loop, Scratch(spark, "t"), ["g"]).collect()} == {"a", "b"}


def test_empty_graph(spark):
    e = edges(spark, [])
    assert G.pagerank(e, Scratch(spark, "t"), ["g"]).count() == 0 and G.components(e, Scratch(spark, "t"), ["g"]).count() == 0
    assert G.betweenness(e, Scratch(spark, "t"), ["g"]).count() == 0


def test_dijkstra_is_whole(spark, tmp_path):
    """A chain of 11 light edges is followed to its end, from every vertex and from the smallest one."""
    from corvigraph.queries.graphs import dijkstra_all_paths, dijkstra_paths

    names = "abcdefghijklm"
    rows = [(f"p{k}", 100 * k + i, x, y, "causes") for k in range(4) for i, (x, y) in enumerate(zip(names, names[1:]))] + [("p0", 1000 + i, x, "m", "causes") for i, x in enumerate("abc")] + [("p0", 2000, "z", "y", "causes")]
    # four patients: each step weighs 1/4, so a-m costs 3 by the chain and 1 by the short cut; a-l only the chain
    spark.createDataFrame(rows, "patient_rowkey string, rel_id long, source_entity_name string, target_entity_name string, relationship_type string").write.parquet(f"{tmp_path}/clinical_relationships.parquet")
    edges = {}
    for p, _, x, y, _ in rows:
        edges.setdefault((x, y), set()).add(p)
    every = sorted({v for e in edges for v in e})
    best = {(v, v): 0.0 for v in every}
    for _ in every:
        for (s, t), d in list(best.items()):
            for (x, y), who in edges.items():
                if x == t and d + 1 / len(who) < best.get((s, y), 1e9):
                    best[s, y] = d + 1 / len(who)
    found = {(r.source, r.target): r.distance for r in dijkstra_all_paths(spark, str(tmp_path)).collect()}
    assert found == {k: round(d, 6) for k, d in best.items()} and found["a", "l"] == 2.75
    assert {(r.source, r.target): r.distance for r in dijkstra_paths(spark, str(tmp_path)).collect()} == {k: d for k, d in found.items() if k[0] == "a"}


def test_pagerank_at_its_fixed_point(spark):
    rows = random_graphs(seed=11) + [("loop", f"v{i}", f"v{(i + 1) % 5}") for i in range(5)]
    exact = {(r.g, r.id): r.rank for r in G.pagerank(edges(spark, rows), Scratch(spark, "t"), ["g"]).collect()}
    for g, pairs in by_graph(rows).items():
        nodes = sorted({x for p in pairs for x in p})
        rank = {x: 1 / len(nodes) for x in nodes}
        out = {x: [b for a, b in pairs if a == x] for x in nodes}
        for _ in range(200):
            lost = sum(rank[x] for x in nodes if not out[x])
            rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == x) + lost / len(nodes)) for x in nodes}
        assert all(math.isclose(exact[g, x], rank[x], rel_tol=1e-7) for x in nodes)


def test_long_paths_and_strong_components(spark):
    rng = random.Random(4)
    chain = [("chain", f"c{i:02}", f"c{i + 1:02}") for i in range(11)]
    ring = [("ring", f"r{i:02}", f"r{(i + 1) % 12:02}") for i in range(12)] + [("ring", "r03", "tail")]
    mixed = [("mix", f"m{a}", f"m{b}") for a, b in {(rng.randrange(14), rng.randrange(14)) for _ in range(22)} if a != b]
    e = edges(spark, chain + ring + mixed)
    paths = {(r.g, r.source, r.target): r.distance for r in G.shortest_paths(e, Scratch(spark, "t"), ["g"]).collect()}
    assert paths["chain", "c00", "c11"] == 11 and paths["ring", "r00", "r11"] == 11
    mid = {r.id: r.betweenness for r in G.betweenness(e, Scratch(spark, "t"), ["g"]).collect() if r.g == "chain"}
    assert math.isclose(mid["c05"], 5 * 6 / (11 * 10))
    got = {(r.g, r.id): r.component for r in G.strong_components(e, Scratch(spark, "t"), ["g"]).collect()}
    for g, pairs in by_graph(chain + ring + mixed).items():
        nodes = {x for p in pairs for x in p}
        reach = {x: set(bfs(pairs, x)[0]) for x in nodes}
        assert {x: got[g, x] for x in nodes} == {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}


def test_labels_that_swing_and_colours(spark):
    star = [("s", "hub", f"l{i}") for i in range(4)]
    got = {r.id: r.community for r in G.label_propagation(edges(spark, star), Scratch(spark, "t"), ["g"]).collect()}
    assert set(got.values()) == {"hub"}
    rows = random_graphs(seed=9)
    colour = {(r.g, r.id): r.colour for r in G.greedy_colours(edges(spark, rows), Scratch(spark, "t"), ["g"]).collect()}
    assert all(colour[g, a] != colour[g, b] for g, a, b in rows) and {x for g, a, b in rows for x in ((g, a), (g, b))} == set(colour)
    for g, pairs in by_graph(rows).items():
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for x in sorted(near):
            taken = {want[y] for y in near[x] if y in want}
            want[x] = next(c for c in range(99) if c not in taken)
        assert want == {x: colour[g, x] for x in near}


def test_hubs_are_spread(spark, monkeypatch):
    from corvigraph.plans import skew

    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", 50, None))
    star = [("s", "hub", f"l{i:03}") for i in range(300)] + [("s", f"l{i:03}", f"x{i % 7}") for i in range(20)]
    assert {r.component for r in G.components(edges(spark, star), Scratch(spark, "t"), ["g"]).collect()} == {"hub"}
    assert math.isclose(sum(r.rank for r in G.pagerank(edges(spark, star), Scratch(spark, "t"), ["g"]).collect()), 1)


def test_power_iteration_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(60)] + [("loop", "loop")]
    edges = G.undirected(spark.createDataFrame(pairs, "src string, dst string"), []).unionByName(spark.createDataFrame([("loop", "loop")], "src string, dst string"))
    short = Scratch(spark, "short")
    runs = [(3, None, 1e-9), (None, 0.01, 1e-4)]
    got = [{r.id: r.value for r in G.power_iteration(edges, short, n, decay, (), bar).collect()} for n, decay, bar in runs]
    assert short._count == 2 * len(runs)  # the edges and the result: no table per round
    monkeypatch.setattr(G, "HELD", 0)
    for one, (n, decay, bar) in zip(got, runs):
        joined = {r.id: r.value for r in G.power_iteration(edges, Scratch(spark, "long"), n, decay, (), bar).collect()}
        assert one.keys() == joined.keys() and all(math.isclose(one[k], joined[k], abs_tol=1e-9) for k in one)


def test_power_iteration_without_fixed_point(spark):
    import pytest

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    with pytest.raises(ValueError):
        G.power_iteration(edges, Scratch(spark, "none"), None, 2.0, (), 1e-9, 3)
