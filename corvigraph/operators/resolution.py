"""Entity resolution: candidate pairs, verification, merging, canonical names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, likeness
from ..plans.scratch import Scratch
from .graph import components
from .ontology import contained_terms

#: Terms in one part of a block of heuristic_pairs.
BLOCK = 500


def vocabulary(mentions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(term): distinct clean texts of all columns; null and blank left out."""
    return mentions.select(F.explode(F.array(*[clean(F.col(c)) for c in columns])).alias("term")).where(F.length("term") > 0).distinct()


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r["v"], np.float64) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(score: np.ndarray, asked: np.ndarray, keys: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best of each row of ``score``, without itself; ties to the smaller key."""
    score = np.where(asked[:, None] == keys[None, :], -np.inf, np.round(score, 9))
    if score.shape[1] > k:  # all that reach the k-th best value, then the order among them
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        row, col = np.nonzero((score >= bar) & np.isfinite(score))
    else:
        row, col = np.nonzero(np.isfinite(score))
    out = pd.DataFrame({"a": asked[row], "b": keys[col], "cosine": score[row, col]}).sort_values(["a", "cosine", "b"], ascending=[True, False, True], kind="stable")
    return out[out.groupby("a").cumcount() < k]


def _pairs_of_blocks(both: DataFrame, k: int, typed: str) -> DataFrame:
    """The k best (a, b, cosine) of block pairs (x, y: arrays of key and v)."""

    def run(parts):
        for part in parts:
            for x, y in zip(part["x"], part["y"]):
                yield _best(_unit(x) @ _unit(y).T, np.array([r["key"] for r in x]), np.array([r["key"] for r in y]), k)

    found = both.select("x", "y").mapInPandas(run, f"a {typed}, b {typed}, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def nearest_neighbours(vectors: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine): the k nearest other vectors of each of ``queries`` (default: of all), exact, ties to the smaller key.

    Vectors are dealt into blocks of bounded size; each block of queries meets each block of vectors in one
    matrix product, and only the best k of a block travel on. The work is queries times vectors by
    definition, memory per task two blocks. Null keys and null vectors take no part.
    """
    typed = dict(vectors.dtypes)[key]

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        df = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        blocks = max(1, -(-df.count() // block))
        held = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
        return held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("rows")), blocks

    right, blocks = packed(vectors)
    left = packed(queries)[0] if queries is not None else right
    left = left.select(F.col("rows").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    return _pairs_of_blocks(left.join(right.select(F.col("block").alias("j"), F.col("rows").alias("y")), "j"), k, typed)


#: Vectors that the cells of an index are fitted on, at most; every vector is indexed.
FITTED = 50_000


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of an index's cells (unit vectors), by k-means over at most FITTED vectors drawn by a hash of their key."""
    drawn = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).limit(FITTED).select(F.col(vector).cast("array<float>").alias("v"))
    rows = drawn.collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(rows)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            mine = x[near == c]
            if len(mine):
                centres[c] = mine.mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def indexed_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, cells: int = 16, probes: int = 12, block: int = 4096) -> DataFrame:
    """(a, b, cosine): near vectors of ``queries`` by an inverted file: every vector lies in its nearest cell, a query visits ``probes`` cells.

    Cells are split into blocks of about ``block`` vectors, so that a cell with a third of all is no single
    task; a query visits all blocks of a cell. Approximate: measure its recall against :func:`nearest_neighbours`.
    """
    typed, centres = dict(vectors.dtypes)[key], fit_cells(vectors, key, vector, cells)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], f"a {typed}, b {typed}, cosine double")

    def placed(df: DataFrame, many: int) -> DataFrame:
        def run(parts):
            for part in parts:
                if len(part):
                    near = np.argsort(-(_unit([{"v": v} for v in part["v"]]) @ centres.T), axis=1, kind="stable")[:, :many]
                    yield pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), near.shape[1]), "v": [v for v in part["v"] for _ in range(near.shape[1])], "cell": near.ravel().astype(np.int32)})

        ok = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        return ok.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).mapInPandas(run, f"key {typed}, v array<float>, cell int")

    index = placed(vectors, 1)
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    pack = lambda df, name: df.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias(name))
    right = pack(index.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "v"), "y")
    asked = placed(queries, probes).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(1, queries.count() // block + 1))).cast("int"))
    left = pack(asked, "x").drop("part").join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _pairs_of_blocks(left.join(right, ["cell", "part"]), k, typed)


def candidate_pairs(neighbours: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, cosine), a < b, of neighbours above ``least`` (a distance below 0.3), seen from a: a pair that only b's list holds is none."""
    return neighbours.where((F.col("cosine") > least) & (F.col("a") < F.col("b"))).select("a", "b", "cosine")


def heuristic_pairs(terms: DataFrame, most: int = 5, whole_words: bool = True) -> DataFrame:
    """(a, b), a < b: terms that share a word and differ in length by at most ``most``, or of which one holds the other (as whole words or, without ``whole_words``, anywhere).

    Every shared word is a block key, with a window of lengths beside it; large blocks are split by hash.
    A pair comes from its first shared word only, so that none is compared or kept twice.
    """
    one = terms.select("term").where(F.length("term") > 0).distinct()
    words = F.filter(F.array_distinct(F.split("term", " ")), lambda x: x != "")
    w = one.select("term", words.alias("words"), F.length("term").alias("len")).withColumn("word", F.explode("words"))
    w = w.withColumn("step", F.floor(F.col("len") / (most + 1)).cast("int"))
    parts = w.groupBy("word", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = w.join(parts, ["word", "step"]).select("word", "step", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), F.col("term").alias("a"), F.col("len").alias("la"), F.col("words").alias("wa"))
    near = w.select("word", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"), F.col("term").alias("b"), F.col("len").alias("lb"), F.col("words").alias("wb"))
    right = near.join(parts, ["word", "step"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    close = left.join(right, ["word", "step", "part"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= most))
    close = close.where(F.array_min(F.array_intersect("wa", "wb")) == F.col("word")).select("a", "b")
    apart = F.abs(F.length("parent") - F.length("child")) > most
    bare = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    inside = contained_terms(one, whole_words).where(apart | ~F.arrays_overlap(bare("parent"), bare("child"))).select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    return close.unionByName(inside)


def verified(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs whose edit likeness is at least ``least``: the stand-in for an external judge; null likeness is no match.

    Signs beyond ASCII count as one and the same.
    """
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    apart = F.coalesce(F.try_divide(F.abs(F.length("a") - F.length("b")).cast("double"), F.greatest(F.length("a"), F.length("b"))), F.lit(0.0))
    near = pairs.where(1 - apart >= least)  # the distance is at least the difference of lengths
    near = near.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism, "a", "b")
    return near.withColumn("likeness", likeness(plain("a"), plain("b"))).where(F.col("likeness") >= least)


def resolve(terms: DataFrame, matches: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, canonical): the shortest, then smallest, term of each component of ``matches``; others are their own."""
    parts = components(matches.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch).select(F.col("id").alias("term"), "component")
    every = terms.join(parts, "term", "left").withColumn("component", F.coalesce("component", "term"))
    best = every.groupBy("component").agg(F.min_by("term", F.struct(F.length("term"), F.col("term"))).alias("canonical"))
    return every.join(best, "component").select("term", "canonical")


def reduction(mapping: DataFrame) -> DataFrame:
    """(before, after, merged, pct) of a canonical mapping."""
    m = mapping.agg(F.countDistinct("term").alias("before"), F.countDistinct("canonical").alias("after"))
    return m.select("before", "after", (F.col("before") - F.col("after")).alias("merged"), F.round(F.coalesce(F.try_divide(100.0 * (F.col("before") - F.col("after")), F.col("before")), F.lit(0.0)), 1).alias("pct"))


def coverage(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(terms, covered, share): how many distinct terms are in ``known`` (term)."""
    t = terms.select("term").distinct().join(known.select("term").distinct().withColumn("hit", F.lit(1)), "term", "left")
    return t.agg(F.count(F.lit(1)).alias("terms"), F.count("hit").alias("covered")).withColumn("share", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("terms")), F.lit(0.0)))


def set_likeness(sets: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, jaccard, overlap, cosine), a < b, of keys that share an item; by shared items and sizes, without comparing other pairs."""
    one = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    size = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    shared = one.withColumnRenamed("k", "a").join(one.withColumnRenamed("k", "b"), "i").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    s = shared.join(size.withColumnsRenamed({"k": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"k": "b", "n": "nb"}), "b")
    return s.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"), (F.col("c") / F.least("na", "nb")).alias("overlap"), (F.col("c") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("cosine"))


def final_score(neighbour: str = "jaccard", text: str = "likeness", penalty: str | None = None, weight: float = 0.5):
    """Weighted neighbour and text likeness, less a penalty for differing descriptors, at least 0."""
    score = weight * F.col(neighbour) + (1 - weight) * F.col(text)
    return F.greatest(F.lit(0.0), score - (F.col(penalty) if penalty else F.lit(0.0)))


def random_projection(edges: DataFrame, scratch: Scratch, size: int = 16, rounds: int = 2, seed: int = 7) -> DataFrame:
    """(id, vector): sums of neighbours' hash-signed projections over ``rounds`` steps, unit length (fast random projection)."""
    from .graph import undirected, vertices_of

    both = scratch.cut(undirected(edges, []), "both")
    sign = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    x = vertices_of(edges, []).select("id", sign.alias("vector"))
    for r in range(rounds):
        cols = [F.avg(F.col("vector")[i]).alias(f"v{i}") for i in range(size)]
        x = scratch.cut(both.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*cols).select("id", F.array(*[f"v{i}" for i in range(size)]).alias("vector")), f"x{r}")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    return x.select("id", F.transform("vector", lambda v: F.coalesce(F.try_divide(v, length), F.lit(0.0))).alias("vector"))
