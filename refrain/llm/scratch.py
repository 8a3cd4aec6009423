"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts the lineage: a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without that setting gets a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="refrain-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables of one run, below one folder; the folder goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._delete_on_exit()

    def _path(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete_on_exit(self) -> None:
        path, fs = self._path(self.folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read from there."""
        at = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_at = at
        return out

    @staticmethod
    def like(df: DataFrame, table: DataFrame) -> DataFrame:
        """df, a view of table, to be dropped with it."""
        df._scratch_at = getattr(table, "_scratch_at", None)
        return df

    def free(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more.

        Its cleaner acts when the driver's heap is collected, which a driver with little to do rarely does by itself.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            at = getattr(t, "_scratch_at", None)
            if at:
                path, fs = self._path(at)
                fs.delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
