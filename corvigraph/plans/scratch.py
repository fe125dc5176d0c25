"""Scratch tables: cut a lineage by writing to the folder that all executors share.

``localCheckpoint`` keeps one copy on one executor, so a lost executor loses the job. A written table
survives, and its reader plans with true file sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine (tests), a fresh local folder.

    On a cluster a machine's own folder would lose rows, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvigraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """A folder of scratch tables for one run of one operator.

    ``cut`` writes a frame and returns a reader of what was written. ``drop`` deletes a table that no
    later step reads; tables that the result still reads stay until the folder's owner clears it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, label: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:04d}-{label}"

    def cut(self, df: DataFrame, label: str = "t") -> DataFrame:
        where = self.path(label)
        df.write.mode("overwrite").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._corvigraph_path = where
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            where = getattr(df, "_corvigraph_path", None)
            if where:
                jvm = self.spark.sparkContext._jvm
                path = jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Deletes all tables of this run: readers of what it wrote end here."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
