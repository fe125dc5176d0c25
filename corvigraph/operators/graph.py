"""Property graphs as vertex and edge tables; every algorithm runs over many graphs at once.

Edges are (keys..., src, dst, ...) and vertices (keys..., id, ...): ``keys`` name the graph a row belongs
to, and may be empty for one graph. Iterations cut their lineage with written tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import spread_join


def build_edges(relations: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One directed edge per ordered pair, with the attributes of the last row by ``order``; no self loops, no null ends."""
    rest = [c for c in relations.columns if c not in (*keys, "src", "dst")]
    ok = relations.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    last = ok.groupBy(*keys, "src", "dst").agg(F.max_by(F.struct(*rest), F.col(order)).alias("a"))
    return last.select(*keys, "src", "dst", "a.*")


def resolve_endpoints(relations: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relations by text as edges by vertex id: unmatched ends and self loops are dropped."""
    v = vertices.select(*keys, "id", "text")
    head = v.withColumnsRenamed({"id": "src", "text": "head"})
    tail = v.withColumnsRenamed({"id": "dst", "text": "tail"})
    return relations.join(head, [*keys, "head"]).join(tail, [*keys, "tail"]).where("src != dst")


def vertices_of(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    e = edges.where("src != dst")
    return e.select(*keys, "src", "dst").union(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mega_graph(edges: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """Edges of all graphs by canonical ends: weight counts them, the first label by ``order`` (else the smallest) stands for all."""
    first = F.min_by(label, F.struct(F.col(order), F.col(label))) if order else F.min(label)
    return edges.where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), first.alias(label))


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, in_degree, out_degree, degree): one pass over both ends of the edges."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(*keys, "x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, centrality): degree over n - 1; a graph of one vertex gives 1."""
    d = degrees(edges, keys)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = d.join(n, list(keys)) if keys else d.crossJoin(F.broadcast(n))
    return both.select(*keys, "id", F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("n") - 1), F.lit(1.0)).alias("centrality"))


def subgraph(edges: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with both ends in ``keep`` (keys, id)."""
    k = keep.select(*keys, "id")
    return edges.join(k.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(k.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi")


def pagerank(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = (), iterations: int | None = None, damping: float = 0.85, weight: str | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(keys, id, rank) summing to 1 in each graph; dangling mass is spread evenly. Without ``weight`` all edges of a vertex count alike.

    The rank is the solution x = 1 + damping * (what the edges bring) scaled to sum 1: the same as with the
    dangling mass in every round, but a graph without cycles is done after its longest path. Rounds go on
    until no x changes by more than ``tolerance`` of its graph's mean. With ``iterations`` it is instead that
    many rounds of the plain power method.
    """
    keys = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    edges = plain = scratch.cut(edges.select(*keys, "src", "dst", w.alias("w")), "edges")
    total = plain.groupBy(*keys, "src").agg(F.sum("w").alias("total"))
    step = scratch.cut(plain.join(total, [*keys, "src"]).select(*keys, "src", "dst", (F.col("w") / F.col("total")).alias("p")), "steps")
    v = vertices_of(edges, keys)
    sizes = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = total.select(*keys, F.col("src").alias("id"), F.lit(False).alias("dangling"))
    joined = v.join(sizes, keys) if keys else v.crossJoin(F.broadcast(sizes))
    v = scratch.cut(joined.join(out, [*keys, "id"], "left").select(*keys, "id", "n", F.coalesce("dangling", F.lit(True)).alias("dangling")), "vertices")

    steps = step.count()

    def brought(values: DataFrame, name: str) -> DataFrame:
        return spread_join(step, values.select(*keys, F.col("id").alias("src"), name), [*keys, "src"], at_most=steps).groupBy(*keys, F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col(name)).alias("got"))

    if iterations is None:
        x = scratch.cut(v.select(*keys, "id", F.lit(1.0).alias("x")), "x0")
        while True:
            new = x.join(brought(x, "x"), [*keys, "id"], "left").select(*keys, "id", (1 + damping * F.coalesce("got", F.lit(0.0))).alias("x"), F.col("x").alias("before"))
            new = scratch.cut(new, "x")
            moved = new.where(F.abs(F.col("x") - F.col("before")) > tolerance).limit(1).count()  # the mean is at least 1
            scratch.drop(x)
            path = new._corvigraph_path
            x = new.drop("before")
            x._corvigraph_path = path
            if not moved:
                break
        mass = x.groupBy(*keys).agg(F.sum("x").alias("mass"))
        scaled = x.join(mass, keys) if keys else x.crossJoin(F.broadcast(mass))
        return scaled.select(*keys, "id", (F.col("x") / F.col("mass")).alias("rank"))
    ranks = scratch.cut(v.select("*", (F.lit(1.0) / F.col("n")).alias("rank")), "ranks")
    for i in range(iterations):
        lost = ranks.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = v.join(brought(ranks, "rank"), [*keys, "id"], "left")
        new = new.join(lost, keys) if keys else new.crossJoin(F.broadcast(lost))
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        new = scratch.cut(new.select(*keys, "id", "n", "dangling", rank.alias("rank")), f"ranks{i}")
        scratch.drop(ranks)
        ranks = new
    return ranks.select(*keys, "id", "rank")


def components(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, component): the smallest id of the weakly connected component.

    Min-label propagation with a jump to the label's own label each round, so that long chains close in
    about log2(length) rounds. Edges of a hub and labels of a giant component are spread over tasks.
    """
    keys = list(keys)
    edges = scratch.cut(edges.select(*keys, "src", "dst"), "edges")  # read twice: whatever made them runs once
    both = scratch.cut(undirected(edges, keys), "both")
    labels = scratch.cut(vertices_of(edges, keys).withColumn("component", F.col("id")), "labels")
    ends, vertices = both.count(), labels.count()
    while True:
        near = spread_join(both, labels.select(*keys, F.col("id").alias("dst"), "component"), [*keys, "dst"], at_most=ends)
        near = near.groupBy(*keys, F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, [*keys, "id"], "left").select(*keys, "id", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = scratch.cut(step, "step")  # read twice
        jump = step.select(*keys, F.col("id").alias("component"), F.col("component").alias("further"))
        new = spread_join(step, jump, [*keys, "component"], "left", at_most=vertices).select(*keys, "id", F.least("component", F.coalesce("further", "component")).alias("component"), "before")
        new = scratch.cut(new, "labels")
        changed = new.where("component != before").limit(1).count()
        scratch.drop(labels, step)
        path = new._corvigraph_path
        labels = new.drop("before")
        labels._corvigraph_path = path
        if not changed:
            return labels


def label_propagation(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = (), iterations: int | None = None) -> DataFrame:
    """(keys, id, community): synchronous rounds, each vertex taking the most frequent label of its neighbours, ties to the smallest.

    Rounds go on until each vertex has the label of two rounds ago: then labels stand still, or swing between
    two, of which the smaller is the result. With ``iterations`` it is that many rounds.
    """
    keys = list(keys)
    edges = scratch.cut(edges.select(*keys, "src", "dst"), "edges")
    both = scratch.cut(undirected(edges, keys), "both")
    labels = scratch.cut(vertices_of(edges, keys).select(*keys, "id", F.col("id").alias("community"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("before")), "labels")
    done, ends = 0, both.count()
    while iterations is None or done < iterations:
        votes = spread_join(both, labels.select(*keys, F.col("id").alias("dst"), "community"), [*keys, "dst"], at_most=ends).groupBy(*keys, F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(*keys, "id").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("best"))
        new = labels.join(best, [*keys, "id"], "left").select(*keys, "id", F.coalesce("best", "community").alias("community"), F.col("community").alias("before"), F.col("before").alias("earlier"))
        new = scratch.cut(new, "labels")
        swings = iterations is None and not new.where("NOT community <=> earlier").limit(1).count()
        scratch.drop(labels)
        path = new._corvigraph_path
        labels = new.drop("earlier")
        labels._corvigraph_path = path
        done += 1
        if swings:
            return labels.select(*keys, "id", F.least("community", "before").alias("community"))
    return labels.select(*keys, "id", "community")


def shortest_paths(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = (), sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(keys, source, target, distance) of unweighted directed paths, self at 0, by frontier joins until none is new, or up to ``most`` steps.

    From all vertices, or from ``sources``: on one large graph all pairs are the square of its vertices.
    """
    keys = list(keys)
    e = scratch.cut(edges.where("src != dst").select(*keys, "src", "dst").distinct(), "edges")
    start = vertices_of(edges, keys) if sources is None else sources.select(*keys, "id").distinct()
    found = scratch.cut(start.select(*keys, F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0).alias("distance")), "found")
    frontier = found
    for d in itertools.count(1):
        if most is not None and d > most:
            break
        new = frontier.join(e.withColumnRenamed("src", "target"), [*keys, "target"]).select(*keys, "source", F.col("dst").alias("target")).distinct()
        new = scratch.cut(new.join(found, [*keys, "source", "target"], "left_anti").withColumn("distance", F.lit(d)), f"frontier{d}")
        if not new.limit(1).count():
            break
        found, frontier = found.unionByName(new), new
    return found


def weighted_paths(edges: DataFrame, scratch: Scratch, weight: str, sources: DataFrame, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(keys, source, target, distance): least sums of non-negative weights, relaxed until nothing improves, or ``most`` times."""
    keys = list(keys)
    e = scratch.cut(edges.where("src != dst").groupBy(*keys, "src", "dst").agg(F.min(F.col(weight).cast("double")).alias("w")), "edges")
    best = scratch.cut(sources.select(*keys, F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("distance")), "best")
    active, rounds = best, 0
    while most is None or rounds < most:
        reach = active.join(e.withColumnRenamed("src", "target"), [*keys, "target"]).select(*keys, "source", F.col("dst").alias("target"), (F.col("distance") + F.col("w")).alias("distance"))
        new = scratch.cut(best.unionByName(reach).groupBy(*keys, "source", "target").agg(F.min("distance").alias("distance")), "best")
        further = scratch.cut(new.join(best, [*keys, "source", "target", "distance"], "left_anti"), "active")
        scratch.drop(best, active)
        best, active, rounds = new, further, rounds + 1
        if not active.limit(1).count():
            break
    return best


def closeness(paths: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, closeness) by incoming distances, scaled by the part of the graph that reaches the vertex."""
    keys = list(keys)
    c = paths.where("distance > 0").groupBy(*keys, F.col("target").alias("id")).agg(F.sum("distance").alias("far"), F.count(F.lit(1)).alias("reach"))
    c = sizes.join(c, [*keys, "id"], "left")
    n = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = c.join(n, keys) if keys else c.crossJoin(F.broadcast(n))
    return c.select(*keys, "id", F.when(F.col("n") > 1, F.coalesce(F.col("reach") / F.col("far") * F.col("reach") / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = (), sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(keys, id, betweenness), directed and normalised by (n-1)(n-2), by level-synchronous joins.

    Forward, each level counts shortest paths from every source; backward, levels from the deepest hand
    down their dependencies; until no path is new, or for ``most`` levels. With ``sources`` only paths from those are summed, scaled to all.
    """
    keys = list(keys)
    edges = scratch.cut(edges.select(*keys, "src", "dst"), "given")
    e = scratch.cut(edges.where("src != dst").distinct(), "edges")
    v = scratch.cut(vertices_of(edges, keys), "vertices")
    start = v if sources is None else sources.select(*keys, "id").distinct()
    levels = [scratch.cut(start.select(*keys, F.col("id").alias("s"), F.col("id").alias("t"), F.lit(1.0).alias("sigma")), "level0")]
    seen = levels[0].select(*keys, "s", "t")
    for d in itertools.count(1):
        if most is not None and d > most:
            break
        reach = levels[-1].join(e.withColumnRenamed("src", "t"), [*keys, "t"]).groupBy(*keys, "s", F.col("dst").alias("t")).agg(F.sum("sigma").alias("sigma"))
        new = scratch.cut(reach.join(seen, [*keys, "s", "t"], "left_anti"), f"level{d}")
        if not new.limit(1).count():
            break
        levels.append(new)
        seen = seen.unionByName(new.select(*keys, "s", "t"))
    delta = levels[-1].select("*", F.lit(0.0).alias("delta"))
    every = delta
    for low in reversed(levels[:-1]):
        up = delta.select(*keys, "s", F.col("t").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("part"))
        share = low.join(e.withColumnRenamed("src", "t"), [*keys, "t"]).join(up, [*keys, "s", "dst"]).groupBy(*keys, "s", "t").agg(F.sum("part").alias("part"))
        delta = scratch.cut(low.join(share, [*keys, "s", "t"], "left").select(*keys, "s", "t", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta")), "delta")
        every = every.unionByName(delta)
    sums = every.where("s != t").groupBy(*keys, F.col("t").alias("id")).agg(F.sum("delta").alias("b"))
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    k = start.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    out = v.join(sums, [*keys, "id"], "left")
    out = out.join(n, keys).join(k, keys) if keys else out.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(k))
    scale = F.coalesce(F.try_divide(F.lit(1.0), (F.col("n") - 1) * (F.col("n") - 2)), F.lit(1.0)) * F.col("n") / F.col("k")
    return out.select(*keys, "id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def triangles(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, c), a < b < c: each triangle once. Edges point from the end of smaller degree, which bounds the open pairs at hubs."""
    keys = list(keys)
    both = undirected(edges, keys)
    deg = both.groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    e = both.join(deg.select(*keys, F.col("id").alias("src"), F.col("deg").alias("ds")), [*keys, "src"]).join(deg.select(*keys, F.col("id").alias("dst"), F.col("deg").alias("dd")), [*keys, "dst"])
    up = e.where(F.struct("ds", "src") < F.struct("dd", "dst")).select(*keys, "src", "dst", "ds", "dd")
    x = up.select(*keys, "src", F.col("dst").alias("y"), F.col("dd").alias("dy"))
    z = up.select(*keys, "src", F.col("dst").alias("z"), F.col("dd").alias("dz"))
    open_ = x.join(z, [*keys, "src"]).where(F.struct("dy", "y") < F.struct("dz", "z"))
    close = up.select(*keys, F.col("src").alias("y"), F.col("dst").alias("z"))
    t = open_.join(close, [*keys, "y", "z"]).select(*keys, F.array_sort(F.array("src", "y", "z")).alias("t"))
    return t.select(*keys, F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering_coefficient(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, triangles, clustering): closed share of a vertex's neighbour pairs; 0 below two neighbours."""
    keys = list(keys)
    t = triangles(edges, keys).select(*keys, F.explode(F.array("a", "b", "c")).alias("id")).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("triangles"))
    d = undirected(edges, keys).groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    out = d.join(t, [*keys, "id"], "left").na.fill(0, ["triangles"])
    return out.select(*keys, "id", "triangles", F.when(F.col("k") > 1, 2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


#: Edges of one graph whose power iteration one task holds; beyond, each round is a join.
HELD = 1_000_000


def _power_in_task(edges: DataFrame, vertices: DataFrame, scratch: Scratch, iterations: int | None, decay: float | None, tolerance: float, most: int) -> DataFrame:
    """The rounds of :func:`power_iteration` over one graph of at most HELD edges, all in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.Index(pdf.loc[pdf["vertex"], "src"])
        ends = pdf[~pdf["vertex"]]
        src, dst = ids.get_indexer(ends["src"]), ids.get_indexer(ends["dst"])
        raw, value, moved = np.ones(len(ids)), np.zeros(len(ids)), False
        for _ in range(most if iterations is None else iterations):
            gain, before = np.bincount(dst, weights=raw[src], minlength=len(ids)), value
            raw = 1 + decay * gain if decay is not None else raw + gain
            with np.errstate(over="ignore", invalid="ignore"):
                value = raw / np.sqrt((raw * raw).sum())
            raw = raw if decay is not None else value
            moved = iterations is None and not (np.abs(value - before) <= tolerance).all()
            if iterations is None and not moved:
                break
        return pd.DataFrame({"id": ids, "value": value, "moved": moved})

    typed = dict(edges.dtypes)["src"]
    both = edges.select("src", "dst", F.lit(False).alias("vertex")).unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("vertex")))
    out = scratch.cut(both.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"id {typed}, value double, moved boolean"), "x")
    if out.where("moved").limit(1).count():
        raise ValueError(f"no fixed point after {most} rounds")
    return out.select("id", "value")


def power_iteration(edges: DataFrame, scratch: Scratch, iterations: int | None = None, decay: float | None = None, keys: Sequence[str] = (), tolerance: float = 1e-9, most: int = 1_000) -> DataFrame:
    """(keys, id, value): eigenvector centrality, or with ``decay`` Katz centrality 1 + decay * incoming; unit length.

    Each round is brought to unit length in its graph; rounds go on until no value changes by more than
    ``tolerance``. If ``most`` rounds do not get there it is an error, as it is for Katz with a decay above the
    inverse of the largest eigenvalue. With ``iterations`` it is that many rounds.
    """
    keys = list(keys)
    e = scratch.cut(edges.where("src != dst").select(*keys, "src", "dst").distinct(), "edges")
    ends = e.count()
    if not keys and ends <= HELD:
        return _power_in_task(e, vertices_of(edges, keys), scratch, iterations, decay, tolerance, most)
    x = scratch.cut(vertices_of(edges, keys).select(*keys, "id", F.lit(1.0).alias("raw"), F.lit(0.0).alias("value")), "x")
    for _ in range(most if iterations is None else iterations):
        got = spread_join(e, x.select(*keys, F.col("id").alias("src"), "raw"), [*keys, "src"], at_most=ends).groupBy(*keys, F.col("dst").alias("id")).agg(F.sum("raw").alias("got"))
        gain = F.coalesce("got", F.lit(0.0))
        new = x.join(got, [*keys, "id"], "left").select(*keys, "id", (1 + decay * gain if decay is not None else F.col("raw") + gain).alias("raw"), F.col("value").alias("before"))
        size = new.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
        new = new.join(size, keys) if keys else new.crossJoin(F.broadcast(size))
        value = F.try_divide("raw", "size")
        new = scratch.cut(new.select(*keys, "id", (F.col("raw") if decay is not None else value).alias("raw"), value.alias("value"), "before"), "x")
        moved = iterations is not None or new.where(F.abs(F.col("value") - F.col("before")) > tolerance).limit(1).count()
        scratch.drop(x)
        path = new._corvigraph_path
        x = new.drop("before")
        x._corvigraph_path = path
        if not moved:
            break
    else:
        if iterations is None:
            raise ValueError(f"no fixed point after {most} rounds")
    return x.select(*keys, "id", "value")


def neighbour_scores(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, common, jaccard, adamic_adar) of vertex pairs with a common neighbour, a < b."""
    keys = list(keys)
    both = undirected(edges, keys)
    deg = both.groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    via = both.select(*keys, F.col("src").alias("via"), F.col("dst").alias("x")).join(deg.withColumnsRenamed({"id": "via", "deg": "via_deg"}), [*keys, "via"])
    pairs = via.withColumnRenamed("x", "a").join(via.select(*keys, "via", F.col("x").alias("b")), [*keys, "via"]).where("a < b")
    n = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log("via_deg")).alias("adamic_adar"))
    n = n.join(deg.select(*keys, F.col("id").alias("a"), F.col("deg").alias("da")), [*keys, "a"]).join(deg.select(*keys, F.col("id").alias("b"), F.col("deg").alias("db")), [*keys, "b"])
    return n.select(*keys, "a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"), "adamic_adar")


def walk_mass(edges: DataFrame, keys: Sequence[str] = (), steps: int = 3, decay: float = 0.8, weight: str | None = None) -> DataFrame:
    """(keys, start, id, mass): expected decayed visits of random walks of ``steps`` steps: the exact form of sampled walks."""
    keys = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(*keys, "src", "dst", w.alias("w"))
    total = e.groupBy(*keys, "src").agg(F.sum("w").alias("total"))
    p = e.join(total, [*keys, "src"]).groupBy(*keys, "src", "dst").agg((F.sum("w") / F.first("total")).alias("p"))
    at = vertices_of(edges, keys).select(*keys, F.col("id").alias("start"), "id", F.lit(1.0).alias("mass"))
    every = None
    for _ in range(steps):
        at = at.join(p.withColumnRenamed("src", "id"), [*keys, "id"]).groupBy(*keys, "start", F.col("dst").alias("id")).agg(F.sum(F.col("mass") * F.col("p") * decay).alias("mass"))
        every = at if every is None else every.unionByName(at)
    return every.groupBy(*keys, "start", "id").agg(F.sum("mass").alias("mass"))


def chains(edges: DataFrame, keys: Sequence[str], labels: Sequence[str], label: str) -> DataFrame:
    """Paths whose edges carry ``labels`` in order: v0, v1, ..., all vertices different."""
    keys = list(keys)
    out = None
    for i, name in enumerate(labels):
        e = edges.where(F.col(label) == name).select(*keys, F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{i + 1}"))
        out = e if out is None else out.join(e, [*keys, f"v{i}"])
        for j in range(i + 1):
            out = out.where(F.col(f"v{j}") != F.col(f"v{i + 1}"))
    return out.select(*keys, *[f"v{i}" for i in range(len(labels) + 1)])


def edit_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """(keys, distance): size of the symmetric difference of two labelled item sets per graph."""
    cols = [*keys, *item]
    a, b = left.select(cols).distinct().withColumn("_l", F.lit(1)), right.select(cols).distinct().withColumn("_r", F.lit(1))
    return a.join(b, cols, "full").groupBy(*keys).agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("distance"))


def wl_colours(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = (), rounds: int = 2) -> DataFrame:
    """(keys, id, colour) after Weisfeiler-Lehman rounds: a digest of one's colour and the sorted colours around; starts from the degree."""
    keys = list(keys)
    both = scratch.cut(undirected(edges, keys), "both")
    x = both.groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("string").alias("colour"))
    for i in range(rounds):
        around = both.join(x.select(*keys, F.col("id").alias("dst"), "colour"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("colour")), ",").alias("around"))
        x = scratch.cut(x.join(around, [*keys, "id"]).select(*keys, "id", F.md5(F.concat_ws("|", "colour", "around")).alias("colour")), f"colours{i}")
    return x


def _trimmed(live: DataFrame, scratch: Scratch, keys: list[str]) -> DataFrame:
    """Edges left after vertices without incoming or outgoing edges are peeled off until none is."""
    while True:
        has_in, has_out = live.select(*keys, F.col("dst").alias("src")).distinct().withColumn("_in", F.lit(True)), live.select(*keys, F.col("src").alias("dst")).distinct().withColumn("_out", F.lit(True))
        marked = scratch.cut(live.join(has_in, [*keys, "src"], "left").join(has_out, [*keys, "dst"], "left").select(*keys, "src", "dst", (F.col("_in") & F.col("_out")).alias("stays")), "trim")
        gone = marked.where("stays IS NULL").limit(1).count()
        scratch.drop(live)
        live = marked.where("stays").drop("stays")
        live._corvigraph_path = marked._corvigraph_path
        if not gone:
            return live


def strong_components(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, component): the smallest vertex of the strongly connected component, by colouring forward and backward.

    Vertices that no cycle can hold are peeled off first. Of the rest each gets the smallest vertex that
    reaches it as colour; those of a colour that reach its name along its own edges are a component; they are
    taken out, and so on. No path length bounds the rounds, and no pairs of vertices are made.
    """
    keys = list(keys)
    every = scratch.cut(vertices_of(edges, keys), "vertices")
    live = _trimmed(scratch.cut(edges.where("src != dst").select(*keys, "src", "dst").distinct(), "live"), scratch, keys)
    found = None
    while live.limit(1).count():
        colour = scratch.cut(vertices_of(live, keys).withColumn("colour", F.col("id")), "colour")
        while True:
            near = spread_join(live, colour.select(*keys, F.col("id").alias("src"), "colour"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
            new = scratch.cut(colour.join(near, [*keys, "id"], "left").select(*keys, "id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") < F.col("colour")).alias("moved")), "colour")
            moved = new.where("moved").limit(1).count()
            scratch.drop(colour)
            colour = new.drop("moved")
            colour._corvigraph_path = new._corvigraph_path
            if not moved:
                break
        inner = live.join(colour.withColumnRenamed("id", "src"), [*keys, "src"]).join(colour.select(*keys, F.col("id").alias("dst"), F.col("colour").alias("other")), [*keys, "dst"]).where("colour = other")
        inner = scratch.cut(inner.select(*keys, "src", "dst"), "inner")
        reach = scratch.cut(colour.where("id = colour"), "reach")
        frontier = reach
        while True:
            back = inner.join(frontier.withColumnRenamed("id", "dst"), [*keys, "dst"]).select(*keys, F.col("src").alias("id"), "colour").distinct()
            frontier = scratch.cut(back.join(reach, [*keys, "id"], "left_anti"), "frontier")
            if not frontier.limit(1).count():
                break
            reach = scratch.cut(reach.unionByName(frontier), "reach")
        found = reach if found is None else found.unionByName(reach)
        gone = reach.select(*keys, "id")
        rest = live.join(gone.withColumnRenamed("id", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_anti")
        live = _trimmed(scratch.cut(rest, "live"), scratch, keys)
    if found is None:
        return every.select(*keys, "id", F.col("id").alias("component"))
    named = found.withColumnRenamed("colour", "component")
    return every.join(named, [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "id").alias("component"))


def bipartite_projection(links: DataFrame, item: str, via: str) -> DataFrame:
    """(a, b, weight), a < b: items by the number of ``via`` they share."""
    one = links.select(item, via).where(F.col(item).isNotNull() & F.col(via).isNotNull()).distinct()
    return one.withColumnRenamed(item, "a").join(one.withColumnRenamed(item, "b"), via).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def adjacency_lists(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, neighbours): sorted distinct successors."""
    return edges.groupBy(*keys, F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def structural_classes(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, role): vertices with the same neighbours share the smallest id among them as role."""
    keys = list(keys)
    lists = undirected(edges, keys).groupBy(*keys, F.col("src").alias("id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("dst")), "\x01"), 256).alias("signature"))
    role = lists.groupBy(*keys, "signature").agg(F.min("id").alias("role"))
    return lists.join(role, [*keys, "signature"]).select(*keys, "id", "role")


def cyclic_vertices(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id) left after vertices without incoming or outgoing edges are peeled off again and again: those on cycles or between them."""
    keys = list(keys)
    return vertices_of(_trimmed(scratch.cut(edges.select(*keys, "src", "dst").distinct(), "live"), scratch, keys), keys)


def modularity_communities(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, community) by greedy merging of the pair of communities with the largest gain of modularity.

    Sequential by nature: one task per graph, for many small graphs. Ties go to the smallest names.
    """
    keys = list(keys)
    typed = dict(edges.dtypes)
    schema = ", ".join([*[f"{k} {typed[k]}" for k in keys], f"id {typed['src']}", f"community {typed['src']}"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = {tuple(sorted(p)) for p in pdf[["src", "dst"]].itertuples(index=False, name=None) if p[0] != p[1]}
        names = sorted({x for p in pairs for x in p})
        if not pairs:
            return pd.DataFrame(columns=[*keys, "id", "community"])
        m = len(pairs)
        share = {x: 0.0 for x in names}
        between: dict[tuple, float] = {}
        for a, b in pairs:
            share[a] += 0.5 / m
            share[b] += 0.5 / m
            between[a, b] = between.get((a, b), 0) + 1 / m
        member = {x: x for x in names}
        while between:
            gain, a, b = max(((v - 2 * share[p] * share[q], p, q) for (p, q), v in between.items()), key=lambda g: (round(g[0], 12), [-ord(c) for c in str(g[1])], [-ord(c) for c in str(g[2])]))
            if gain <= 1e-12:
                break
            share[a] += share.pop(b)
            merged: dict[tuple, float] = {}
            for (p, q), v in between.items():
                p, q = (a if p == b else p), (a if q == b else q)
                if p != q:
                    k = (p, q) if p < q else (q, p)
                    merged[k] = merged.get(k, 0) + v
            between = merged
            member = {x: (a if c == b else c) for x, c in member.items()}
        head = {k: pdf[k].iloc[0] for k in keys}
        smallest: dict = {}
        for x in names:
            smallest.setdefault(member[x], x)
        return pd.DataFrame([{**head, "id": x, "community": smallest[member[x]]} for x in names])

    return edges.select(*keys, "src", "dst").groupBy(*keys).applyInPandas(one, schema)


def sampled_walks(edges: DataFrame, walks: int, length: int, seed: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, walk): vertex sequences; the next vertex is drawn by a hash of walk and step, so that runs agree."""
    keys = list(keys)
    lists = adjacency_lists(edges, keys)
    at = vertices_of(edges, keys).select(*keys, "id", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("no"))
    at = at.select(*keys, "no", F.col("id").alias("start"), "id", F.array(F.col("id").cast("string")).alias("walk"))
    for step in range(length):
        pick = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "no", "start", "id"), F.size("neighbours")).cast("int")
        moved = at.join(lists, [*keys, "id"], "left")
        nxt = F.get("neighbours", pick)
        at = moved.select(*keys, "no", "start", F.coalesce(nxt, "id").alias("id"), F.when(nxt.isNotNull(), F.concat("walk", F.array(nxt.cast("string")))).otherwise(F.col("walk")).alias("walk"))
    return at.select(*keys, "walk")


def walk_embeddings(edges: DataFrame, size: int = 16, walks: int = 5, length: int = 6, seed: int = 7) -> DataFrame:
    """(id, vector): skip-gram vectors of vertices over sampled walks."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, minCount=1, inputCol="walk", outputCol="v", seed=seed, maxIter=1).fit(sampled_walks(edges, walks, length, seed))
    return model.getVectors().withColumnRenamed("word", "id")


def graphlets(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, edges, wedges, triangles): connected graphlets of two and three vertices; wedges are open, counted from degrees without listing them."""
    keys = list(keys)
    both = undirected(edges, keys)
    d = both.groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    pairs = d.groupBy(*keys).agg((F.sum("d") / 2).cast("long").alias("edges"), F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("pairs"))
    t = triangles(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("triangles"))
    out = pairs.join(t, keys, "left") if keys else pairs.crossJoin(F.broadcast(t))
    return out.select(*keys, "edges", (F.col("pairs") - 3 * F.coalesce("triangles", F.lit(0))).alias("wedges"), F.coalesce("triangles", F.lit(0)).alias("triangles"))


def label_kernel(edges: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(a, b, kernel), a < b: cosine of two graphs' counts of edge labels, for graphs that share one (a label-histogram kernel)."""
    one = edges.groupBy(F.col(keys[0]).alias("k"), F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = one.groupBy("k").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    both = one.withColumnsRenamed({"k": "a", "n": "x"}).join(one.withColumnsRenamed({"k": "b", "n": "y"}), "label").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = both.join(size.withColumnsRenamed({"k": "a", "size": "sa"}), "a").join(size.withColumnsRenamed({"k": "b", "size": "sb"}), "b")
    return both.select("a", "b", (F.col("dot") / (F.col("sa") * F.col("sb"))).alias("kernel"))


def anonymous_walks(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pattern, walks): walks of two steps along undirected edges by the order in which their vertices first appear: 0-1-0 and 0-1-2."""
    keys = list(keys)
    d = undirected(edges, keys).groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("d"))
    sums = d.groupBy(*keys).agg(F.sum("d").alias("back"), F.sum(F.col("d") * (F.col("d") - 1)).alias("on"))
    return sums.select(*keys, F.explode(F.array(F.struct(F.lit("0-1-0").alias("pattern"), F.col("back").alias("walks")), F.struct(F.lit("0-1-2").alias("pattern"), F.col("on").alias("walks")))).alias("w")).select(*keys, "w.*").where("walks > 0")


def greedy_colours(edges: DataFrame, scratch: Scratch, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, colour): no two neighbours share a colour. Vertices are coloured in the order of their names, each with the least colour free.

    In a round every vertex whose smaller neighbours all have colours gets its own, so a round colours many at once.
    """
    keys = list(keys)
    both = undirected(edges, keys)
    down = scratch.cut(both.where("dst < src"), "down")
    done = scratch.cut(vertices_of(edges, keys).join(down.select(*keys, F.col("src").alias("id")).distinct(), [*keys, "id"], "left_anti").withColumn("colour", F.lit(0)), "done")
    left = down
    while left.limit(1).count():
        seen = left.join(done.select(*keys, F.col("id").alias("dst"), "colour"), [*keys, "dst"], "left")
        ready = seen.groupBy(*keys, F.col("src").alias("id")).agg(F.collect_set("colour").alias("taken"), F.count_if(F.col("colour").isNull()).alias("open")).where("open = 0")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        new = scratch.cut(ready.select(*keys, "id", free.alias("colour")), "new")
        left = scratch.cut(left.join(new.select(*keys, F.col("id").alias("src")), [*keys, "src"], "left_anti"), "left")
        done = scratch.cut(done.unionByName(new), "done")
    return done
