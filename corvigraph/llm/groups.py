"""Groups of records linked directly or through others, by deterministic Boruvka hooking (problem 5).

Names are numbered by their rank, so numbers, and with them every choice below, are the same in every
run. Each round every component hooks onto the other end of its smallest outgoing edge, in the order of
the original edges' numbers; the hooks form trees whose only cycles are pairs that chose the same edge,
where the smaller becomes root; pointer doubling collapses the trees; edges are relabelled and
deduplicated, each kept with its smallest original. Components at least halve in number, so there are at
most log2(n) rounds. All state is in written tables. Joins on a hub, a root or a giant component spread
that key over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import HOT_ROWS, spread_join


def _roots(hooks: DataFrame, scratch: Scratch, least: int, nodes: int) -> DataFrame:
    """(node, root) from written (node, parent) trees whose roots are their own parents, by pointer doubling."""
    at = hooks
    while True:
        up = at.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        to = scratch.cut(spread_join(at, up, ["parent"], least=least, at_most=nodes).select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "doubled")
        moved = to.where("moved").limit(1).count()
        scratch.drop(at)
        at = to.drop("moved")
        at._corvigraph_path = to._corvigraph_path
        if not moved:
            return at.withColumnRenamed("parent", "root")


def component_roots(edges: DataFrame, scratch: Scratch, least: int = HOT_ROWS) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long ids): root is one node of its component.

    Self loops and repeated edges change nothing; a node with only a self loop is its own root. Keys with
    more than ``least`` rows are spread over tasks.
    """
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = scratch.cut(nodes.select("node", F.col("node").alias("root")), "members")
    count = members.count()
    live = scratch.cut(both.where("a != b").distinct().select("a", "b", F.struct("a", "b").alias("edge")), "edges")
    while edges_left := live.count():
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x"), "edge")
        picks = ends.groupBy("x.node").agg(F.min(F.struct(F.col("edge"), F.col("x.other").alias("other"))).alias("m"))
        picks = scratch.cut(picks.select("node", F.col("m.other").alias("parent"), F.col("m.edge").alias("edge")), "picks")
        mate = picks.select(F.col("node").alias("parent"), F.col("edge").alias("mate_edge"))
        mutual = (F.col("edge") == F.col("mate_edge")) & (F.col("node") < F.col("parent"))
        hooks = spread_join(picks, mate, ["parent"], least=least, at_most=count).select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent"))
        roots = _roots(scratch.cut(hooks, "hooks"), scratch, least, count)
        to_a, to_b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = spread_join(live, to_a, ["a"], least=least, at_most=edges_left)
        half = scratch.cut(half, "half") if edges_left > least else half
        moved = spread_join(half, to_b, ["b"], least=least, at_most=edges_left).where("ra != rb")
        after = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("edge").alias("edge"))
        after = scratch.cut(after, "edges")
        joined = spread_join(members, roots.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], "left", least, count)
        later = scratch.cut(joined.select("node", F.coalesce("top", "root").alias("root")), "members")
        scratch.drop(live, members, picks, roots)
        live, members = after, later
    return members


def ranked(names: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, id): distinct names numbered from 0 in their order, without a global window over them.

    Ranges of names are sorted and numbered each by itself; the ranges' sizes, a row for each partition,
    are summed up and added.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = names.repartitionByRange("name").sortWithinPartitions("name").select("name", F.spark_partition_id().alias("part"), place.alias("place"))
    held = scratch.cut(held, "ranges")
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    return scratch.cut(held.join(F.broadcast(sizes), "part").select("name", (F.col("before") + F.col("place")).alias("id")), "names")


def named_groups(links: DataFrame, scratch: Scratch, least: int = HOT_ROWS) -> DataFrame:
    """(group_name, member) of ``links`` (x, y: strings): group_name is the smallest name of the group.

    One row for every member, the group's name too. Links with a null end are no links; a name linked
    only to itself is a group of one. The rounds move numbers, not names.
    """
    pairs = scratch.cut(links.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct(), "links")
    names = ranked(pairs.select(F.explode(F.array("x", "y")).alias("name")).distinct(), scratch)
    half = scratch.cut(spread_join(pairs, names.select(F.col("name").alias("x"), F.col("id").alias("a")), ["x"], least=least).select("a", "y"), "half")
    edges = spread_join(half, names.select(F.col("name").alias("y"), F.col("id").alias("b")), ["y"], least=least).select("a", "b")
    roots = component_roots(scratch.cut(edges, "ids"), scratch, least)
    named = scratch.cut(roots.join(names.withColumnRenamed("id", "node"), "node").select("root", "name"), "named")
    first = named.groupBy("root").agg(F.min("name").alias("group_name"))
    return spread_join(named, first, ["root"], least=least).select("group_name", F.col("name").alias("member"))
