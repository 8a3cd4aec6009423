"""The catalogue of known recordings: versioned Parquet behind a pointer, upserts and retention.

A version is a folder that is never changed. Writing makes a new one and then replaces the pointer
file, so that readers see the old version or the new one whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.operators.search import META, stored
from refrain.sources.store import checkpointed

SCHEMA = (
    "source_id string, source_name string, source_path string, source_type string, extractor_id string, kind string, "
    "start_s double, end_s double, start_byte long, end_byte long, q array<tinyint>, q_norm float, sequence long"
)


def retained(sources: DataFrame, limit: int) -> DataFrame:
    """sources(source_id, source_type, sequence) without recordings beyond the newest ``limit``; 0: all.

    Only the recordings' ids are ranked; other types always stay.
    """
    if limit <= 0:
        return sources
    recording = F.coalesce(F.col("source_type") == "recording", F.lit(False))
    newest = sources.filter(recording).orderBy(F.col("sequence").desc(), F.col("source_id").desc()).limit(limit)  # the top of each part, then of those
    return sources.filter(~recording).unionByName(newest)


def upserted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors without those of the sources in new, and new."""
    return vectors.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new)


def counters(vectors: DataFrame) -> DataFrame:
    """One row: vectors, sources, recordings, extractors."""
    recording = F.when(F.col("source_type") == "recording", F.col("source_id"))
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.count_distinct("source_id").alias("sources"),
        F.count_distinct(recording).alias("recordings"),
        F.count_distinct("extractor_id").alias("extractors"),
    )


def check_spaces(vectors: DataFrame, new: DataFrame) -> None:
    """An extractor has one kind and one length; empty ids are refused."""
    space = lambda df, v: df.select("source_id", "extractor_id", "kind", F.size(v).alias("dim"))
    every = space(vectors, "q").unionByName(space(new, "values"))
    if not every.groupBy("extractor_id").agg(F.count_distinct("kind", "dim").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("an extractor was registered with another kind or length")
    if not new.filter("source_id IS NULL OR source_id = '' OR extractor_id IS NULL OR extractor_id = ''").isEmpty():
        raise ValueError("sources and extractors need an id")


class Catalog:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self._path(f"{self.root}/current"))

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/current").first()[0])

    def create(self, maximum_recordings: int = 0) -> None:
        if self.exists():
            raise FileExistsError(self.root)
        self._commit(self.spark.createDataFrame([], SCHEMA), {"maximum_recordings": self._limit(maximum_recordings), "next_sequence": 1})

    @staticmethod
    def _limit(n: int) -> int:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("maximum_recordings must be 0 or more")
        return n

    def _commit(self, vectors: DataFrame, meta: dict) -> None:
        version = f"v-{uuid.uuid4().hex}"
        vectors.write.partitionBy("extractor_id").parquet(f"{self.root}/{version}")
        text = json.dumps(meta | {"version": version}) + "\n"
        fresh, current = self._path(f"{self.root}/current.{version}"), self._path(f"{self.root}/current")
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri())
        array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(fresh, current, array)

    def vectors(self) -> DataFrame:
        """All vectors of the sources that retention keeps."""
        meta = self.meta()
        out = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{meta['version']}")
        return self._kept(out, meta["maximum_recordings"])

    @staticmethod
    def _kept(vectors: DataFrame, limit: int) -> DataFrame:
        if not limit:
            return vectors
        sources = vectors.select("source_id", "source_type", "sequence").distinct()
        return vectors.join(retained(sources, limit).select("source_id"), "source_id", "left_semi")

    def replace_sources(self, vectors: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
        """Replace the named sources by their base vectors, in the order of ids; returns the source_id of those evicted.

        ids are names, or a table with a column source_id, taken in its order. A name without vectors is removed.
        Each gets a new sequence number, which makes it the newest. Ids stay in tables, however many there are.
        """
        if not isinstance(ids, DataFrame):
            if not ids or any(not i for i in ids):
                raise ValueError("sources need an id")
            named = self.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "source_id string, place long")
        else:
            if not ids.filter("source_id IS NULL OR source_id = ''").isEmpty():
                raise ValueError("sources need an id")
            ranked = Window.orderBy("source_id")  # names only, one row per recording of a batch
            named = ids.select("source_id").distinct().select("source_id", (F.row_number().over(ranked) - 1).cast("long").alias("place"))
        named = checkpointed(named)
        if not vectors.join(named, "source_id", "left_anti").isEmpty():
            raise ValueError("vectors of other sources")
        meta, old = self.meta(), self.vectors()
        rest = old.join(named, "source_id", "left_anti")
        check_spaces(rest, vectors)
        new = stored(vectors.select(*META, "values"), F.lit(0).cast("long")).drop("sequence")
        new = new.join(named, "source_id").withColumn("sequence", F.col("place") + meta["next_sequence"])
        every = rest.select(*old.columns).unionByName(new.select(*old.columns))
        known = checkpointed(every.select("source_id", "source_type", "sequence").distinct())
        kept = retained(known, meta["maximum_recordings"])
        gone = checkpointed(known.join(kept.select("source_id"), "source_id", "left_anti").select("source_id").distinct())
        out = every if not meta["maximum_recordings"] else every.join(gone, "source_id", "left_anti")
        self._commit(out, meta | {"next_sequence": meta["next_sequence"] + named.count()})
        return gone.orderBy("source_id")

    def configure(self, maximum_recordings: int) -> None:
        self._commit(self._kept(self.vectors(), self._limit(maximum_recordings)), self.meta() | {"maximum_recordings": maximum_recordings})

    def info(self) -> dict:
        row = counters(self.vectors()).first().asDict()
        return {"schema_version": 4, **row, "maximum_recordings": self.meta()["maximum_recordings"]}
