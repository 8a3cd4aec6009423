"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators.search import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a base vector of its own source."""
    e = table(spark, sf_dir, "embeddings")
    at = F.col("vec_id").cast("double")
    return e.select(
        F.col("vec_id").cast("string").alias("source_id"), F.lit("").alias("source_name"), F.lit("").alias("source_path"), F.lit("unknown").alias("source_type"),
        F.lit("embedding:d64").alias("extractor_id"), F.lit("video_perceptual").alias("kind"), at.alias("start_s"), (at + 1).alias("end_s"),
        F.col("vec_id").alias("start_byte"), F.col("vec_id").alias("end_byte"), F.col("embedding").alias("values"),
    )


def recording_vectors(spark: SparkSession, sf_dir: str, spaces: int = 1) -> DataFrame:
    """All embeddings as recordings of a minute, sixty vectors each.

    Groups of eight recordings share a passage of 15 s, every other one of them also one of 8 s; each repeats 7 s of its own.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rec, t = F.floor(F.col("vec_id") / 60), F.col("vec_id") % 60
    places = e.select(rec.alias("rec"), t.alias("t"))
    rec, t = F.col("rec"), F.col("t")
    first = (rec - rec % 8) * 60
    shared = t.between(10, 24) | (t.between(30, 37) & (rec % 2 == 0))
    vec = F.when(shared, first + t).when(t.between(50, 56), rec * 60 + t - 10).otherwise(rec * 60 + t)
    at = t.cast("double")
    return places.withColumn("vec_id", vec).join(e, "vec_id").select(
        F.concat(F.lit("rec-"), rec).alias("source_id"), F.lit("").alias("source_name"), F.lit("").alias("source_path"), F.lit("recording").alias("source_type"),
        F.concat(F.lit("space-"), t % spaces).alias("extractor_id"), F.lit("video_perceptual").alias("kind"), at.alias("start_s"), (at + 1).alias("end_s"),
        (t * 1000).alias("start_byte"), (t * 1000 + 999).alias("end_byte"), F.col("embedding").alias("values"),
    )


def recording_catalogue(queries: DataFrame) -> DataFrame:
    """The same recordings as stored, in the order of their names."""
    return stored(queries, F.substring("source_id", 5, 9).cast("long"))


def intervals(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """Events as intervals: by, event_id, event_type, start_s since the first of January 2024, end_s, value."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)
    rows = table(spark, sf_dir, "events").select(F.col(by).alias("k"), "event_id", "event_type", at.alias("start_s"), "value")
    return rows.withColumn("end_s", F.col("start_s") + F.col("value") * 60)


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as match spans of twenty recordings with one reference per type."""
    i = F.col("event_id")
    length = (5 + i % 17).cast("double")
    start, other = (i * 7 % 600).cast("double"), (i * 7 % 300).cast("double")
    minus = F.lit(-1).cast("long")
    return table(spark, sf_dir, "events").select(
        i.alias("match_id"), F.concat(F.lit("rec-"), F.col("user_id") % 20).alias("source_id"), F.col("event_type").alias("reference_id"), F.lit("").alias("reference_name"),
        F.lit("").alias("reference_path"), F.when(i % 29 == 0, "advertisement").otherwise("unknown").alias("reference_type"),
        F.when(i % 2 == 0, "audio_spectrum").otherwise("video_perceptual").alias("kind"), (F.lit(0.955) + (i % 5) * F.lit(0.01)).cast("float").alias("similarity"),
        start.alias("q_start"), (start + length).alias("q_end"), other.alias("r_start"), (other + length).alias("r_end"),
        minus.alias("q_start_byte"), minus.alias("q_end_byte"), minus.alias("r_start_byte"), minus.alias("r_end_byte"),
    )
