"""Items that appear together, kept up to date by signed deltas (problem 4).

State lies in one folder: a table of item counts, a table of pair counts with the counts of both ends, each
in hash buckets, and a manifest that names the files of every bucket. A batch of changed baskets emits
signed deltas of what it adds and takes away (what stays in a basket emits nothing); they are summed before
any shuffle and merged into the buckets they touch. A pair whose count or whose ends' counts changed is
affected: only affected pairs get their marginals anew, and only their buckets are written again. The
manifest is replaced last, in one step, so a lost executor or a failed batch leaves the former state, and
another session opens the state where this one left it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import HOT_ROWS, spread_join

#: Rows of a bucket from which the number of buckets is doubled.
PER_BUCKET = 1_000_000


def signed(changes: DataFrame) -> DataFrame:
    """(sign, changed, kept): of each changed basket the items it lost (-1) and won (+1), each once, and those that stay.

    ``changes`` is (old, new) arrays of strings; null means that the basket was or is not there. Baskets
    whose item sets are equal have no row.
    """
    once = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    sets = changes.select(once("old").alias("old"), once("new").alias("new"))
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.array_except("old", "new").alias("changed")), F.struct(F.lit(1).alias("sign"), F.array_except("new", "old").alias("changed")))
    return sets.select(F.array_intersect("old", "new").alias("kept"), F.explode(both).alias("x")).where("size(x.changed) > 0").select("x.sign", "x.changed", "kept")


def item_deltas(deltas: DataFrame) -> DataFrame:
    """(item, n): summed signs; items whose changes cancel are left out."""
    return deltas.select("sign", F.explode("changed").alias("item")).groupBy("item").agg(F.sum("sign").alias("n")).where("n != 0")


def pair_deltas(deltas: DataFrame) -> DataFrame:
    """(a, b, n), a < b: summed signs of the pairs that a changed item makes, summed on the map side first."""
    one = deltas.select("sign", "kept", "changed", F.explode("changed").alias("x"))
    other = F.concat("kept", F.filter("changed", lambda y: y > F.col("x")))
    two = one.select("sign", "x", F.explode(other).alias("y"))
    return two.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("sign").alias("n")).where("n != 0")


class Folder:
    """A folder of the shared file system: small files by name, data below it."""

    def __init__(self, spark, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames, so that a reader sees the old file or the new one."""
        fresh, fs = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        path, _ = self._path(name)
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(fresh, path):
            raise OSError(f"cannot replace {self.where}/{name}")

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)


class Buckets:
    """A table in hash buckets of all its keys. ``state`` is its part of the manifest: buckets, rows, and the files of each bucket."""

    def __init__(self, folder: Folder, name: str, keys: list[str], schema: str, state: dict):
        self.folder, self.name, self.keys, self.schema, self.state = folder, name, keys, schema, state

    def bucket(self, count: int | None = None):
        return F.pmod(F.xxhash64(*self.keys), F.lit(count or self.state["buckets"])).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets or of some."""
        by_version: dict[str, list[int]] = {}
        for b, where in self.state["files"].items():
            if only is None or int(b) in only:
                by_version.setdefault(where, []).append(int(b))
        columns, out = [c.split()[0] for c in self.schema.split(", ")], None
        for where, held in sorted(by_version.items()):
            part = self.folder.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder.where}/{where}").where(F.col("bucket").isin(held)).select(*columns)
            out = part if out is None else out.unionByName(part)
        return self.folder.spark.createDataFrame([], self.schema) if out is None else out

    def grown(self, more: int) -> bool:
        """Doubles the buckets until ``more`` rows find room; then all of them must be written again."""
        before = self.state["buckets"]
        while self.state["rows"] + more > PER_BUCKET * self.state["buckets"]:
            self.state["buckets"] *= 2
        return self.state["buckets"] > before

    def write(self, rows: DataFrame, touched: list[int]) -> None:
        """Puts ``rows`` in place of all that the touched buckets held. Each bucket is one file."""
        where = f"{self.name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.folder.where}/{where}")
        self.state["files"] = {b: w for b, w in self.state["files"].items() if int(b) not in set(touched)} | {str(b): where for b in touched}
        self.state["rows"] = self.read().count()


class PairTable:
    """Incremental counts of items and pairs over baskets, with the number of baskets given from outside.

    ``folder`` holds the state: one that exists is opened and goes on; without it the state lives in the
    scratch folder. ``buckets`` is the number to begin with.
    """

    def __init__(self, scratch: Scratch, buckets: int = 8, folder: str | None = None):
        self.scratch = scratch
        self.folder = Folder(scratch.spark, folder or f"{scratch.root}/state")
        held = self.folder.read("manifest.json")
        fresh = lambda: {"buckets": buckets, "rows": 0, "files": {}}
        self.state = json.loads(held) if held else {"batches": 0, "items": fresh(), "pairs": fresh()}
        self._open()

    def _open(self) -> None:
        self.items = Buckets(self.folder, "items", ["item"], "item string, n long", self.state["items"])
        self.pairs = Buckets(self.folder, "pairs", ["a", "b"], "a string, b string, n long, n_a long, n_b long", self.state["pairs"])

    def _touched(self, table: Buckets, rows: DataFrame, more: int) -> list[int]:
        """Buckets of ``rows``, or all where the table has grown; at most one number for each bucket comes to the driver."""
        if table.grown(more):
            return list(range(table.state["buckets"]))
        return sorted(r.b for r in rows.select(table.bucket().alias("b")).distinct().collect())

    def apply(self, changes: DataFrame) -> DataFrame:
        """Merges a batch of (old, new) baskets. Returns (a, b, n, n_a, n_b) of the pairs it affected."""
        deltas = self.scratch.cut(signed(changes), "deltas")
        d_items = self.scratch.cut(item_deltas(deltas), "items-delta")
        d_pairs = self.scratch.cut(pair_deltas(deltas), "pairs-delta")

        old_state = json.loads(json.dumps(self.state))
        try:
            touched = self._touched(self.items, d_items, d_items.count())
            total = self.items.read(touched if touched and old_state["items"]["buckets"] == self.items.state["buckets"] else None)
            if touched:
                self.items.write(total.unionByName(d_items).groupBy("item").agg(F.sum("n").alias("n")).where("n != 0"), touched)
            items = self.items.read()

            before = self.pairs.read()
            stale = before.select("a", "b").limit(0)
            if old_state["pairs"]["files"] and touched:
                won = d_items.select(F.col("item").alias("a"), F.lit(True).alias("hit_a"))
                many = self.state["pairs"]["rows"]
                half = spread_join(before.select("a", "b"), won, ["a"], "left", at_most=many)
                half = self.scratch.cut(half, "half") if many > HOT_ROWS else half
                both = spread_join(half, won.withColumnsRenamed({"a": "b", "hit_a": "hit_b"}), ["b"], "left", at_most=many)
                stale = self.scratch.cut(both.where("hit_a OR hit_b").select("a", "b"), "stale")
            none = F.lit(None).cast("long")
            fresh = d_pairs.unionByName(stale.select("a", "b", F.lit(0).cast("long").alias("n")))
            fresh = fresh.select("a", "b", "n", none.alias("n_a"), none.alias("n_b"), F.lit(True).alias("fresh"))
            touched = self._touched(self.pairs, fresh, d_pairs.count())
            held = self.pairs.read(touched if old_state["pairs"]["buckets"] == self.pairs.state["buckets"] else None).withColumn("fresh", F.lit(False))
            merged = held.unionByName(fresh).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.bool_or("fresh").alias("fresh"))
            merged = self.scratch.cut(merged.where("n != 0"), "merged")
            many = merged.count()
            anew = spread_join(merged.where("fresh").select("a", "b", "n"), items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), ["a"], at_most=many)
            anew = self.scratch.cut(anew, "half") if many > HOT_ROWS else anew
            anew = spread_join(anew, items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), ["b"], at_most=many)
            anew = self.scratch.cut(anew.select("a", "b", "n", "n_a", "n_b"), "affected")
            if touched:
                self.pairs.write(merged.where("NOT fresh").drop("fresh").unionByName(anew), touched)
            self.state["batches"] += 1
            self.folder.replace("manifest.json", json.dumps(self.state))
        except BaseException:
            self.state = old_state
            self._open()
            raise
        self.scratch.drop(deltas, d_items, d_pairs, merged)
        return anew

    def scores(self, total: DataFrame, least: int = 1, affected: DataFrame | None = None) -> DataFrame:
        """(a, b, n, n_a, n_b, total, lift, npmi) of pairs in at least ``least`` baskets, from the stored counts without a join.

        ``total`` is one row with the number of baskets. With ``affected`` (item) only pairs of such items.
        Empty state gives no rows.
        """
        pairs = self.pairs.read().where(F.col("n") >= least)
        if affected is not None:
            hit = pairs.join(affected.withColumnRenamed("item", "a"), "a", "left_semi")
            pairs = hit.unionByName(pairs.join(affected.withColumnRenamed("item", "b"), "b", "left_semi")).distinct()
        both = pairs.crossJoin(F.broadcast(total.select(F.col(total.columns[0]).alias("total"))))
        lift = F.col("n") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
        npmi = F.when(F.col("n") < F.col("total"), F.log(lift) / -F.log(F.col("n") / F.col("total"))).otherwise(F.lit(1.0))
        return both.select("a", "b", "n", "n_a", "n_b", "total", lift.alias("lift"), npmi.alias("npmi"))

    def vacuum(self) -> None:
        """Deletes files that no bucket names any more. Readers of an earlier state end here."""
        live = {w for t in ("items", "pairs") for w in self.state[t]["files"].values()}
        path, fs = self.folder._path(".")
        for f in fs.listStatus(path):
            name = f.getPath().getName()
            if f.isDirectory() and name.split("-")[0] in ("items", "pairs") and name not in live:
                self.folder.delete(name)
