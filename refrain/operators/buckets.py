"""Tumbling buckets and hopping windows over decoded media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.features import AudioExtractor
from refrain.options import AnalyzerOptions


#: No recording is longer; a time beyond it is a broken clock.
LONGEST_SECONDS = 7 * 86400.0


def tumbling(events: DataFrame, by: list[str], at: Column, width: float, aggregates: dict[str, Column], longest: float | None = None) -> DataFrame:
    """by, bucket, start_s, end_s and aggregates; buckets without rows stand between those with some.

    With ``longest``, rows at a later time raise an error: one broken clock would ask for billions of buckets.
    """
    if longest is not None:
        at = F.when(at > longest, F.raise_error(F.lit(f"a recording is longer than {longest:.0f} seconds")).cast("double")).otherwise(at)
    rows = events.withColumn("bucket", F.greatest(F.lit(0).cast("long"), F.floor(at / width)))
    full = rows.groupBy(*by, "bucket").agg(*[c.alias(k) for k, c in aggregates.items()])
    every = full.groupBy(*by).agg(F.max("bucket").alias("last")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    out = every.join(full, [*by, "bucket"], "left")
    return out.withColumns({"start_s": F.col("bucket") * F.lit(float(width)), "end_s": (F.col("bucket") + 1) * F.lit(float(width))})


def byte_envelope(position: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte (inclusive) of packets; packets without place or size do not count."""
    good = (position >= 0) & (size > 0)
    return F.min(F.when(good, position)), F.max(F.when(good, position + size - 1))


def hopping(events: DataFrame, by: list[str], at: Column, width: float, hop: float, aggregates: dict[str, Column]) -> DataFrame:
    """by, start_s, end_s and aggregates over windows of width that begin at every multiple of hop from 0 on."""
    last = F.floor(at / hop).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - width) / hop).cast("long") + 1)
    rows = events.filter(at >= 0).withColumn("step", F.explode(F.sequence(first, last)))
    out = rows.groupBy(*by, "step").agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.withColumns({"start_s": F.col("step") * F.lit(float(hop)), "end_s": F.col("step") * F.lit(float(hop)) + F.lit(float(width))}).drop("step")


def video_buckets(frames: DataFrame, options: AnalyzerOptions) -> DataFrame:
    """source_id, bucket, video: the unit mean of the features of a bucket's first two frames.

    frames has source_id, seq, t and feature array<float>.
    """
    from pyspark.sql import Window

    from refrain.functions.vectors import normalised

    placed = frames.withColumn("bucket", F.greatest(F.lit(0).cast("long"), F.floor(F.col("t") / options.bucket_seconds)))
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "bucket").orderBy("seq"))).filter("n <= 2")
    means = first.select("source_id", "bucket", F.posexplode("feature").alias("i", "x")).groupBy("source_id", "bucket", "i").agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"))
    lists = means.groupBy("source_id", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return lists.select("source_id", "bucket", F.coalesce(normalised(F.col("mean")), "mean").alias("video"))


def audio_windows(buckets: DataFrame, options: AnalyzerOptions, rate: int = 8000) -> DataFrame:
    """Windows of a bucket's length every hop, of buckets(source_id, bucket, samples, start_byte, end_byte).

    A window is made only if it is full: of its bucket's samples and the next bucket's. Bytes are
    interpolated in the bucket where an edge falls, -1 where unknown.
    """
    from pyspark.sql import Window

    width, hop = options.bucket_seconds, options.audio_hop_seconds
    need = max(1, int(width * rate + 0.5))
    w = Window.partitionBy("source_id").orderBy("bucket")
    some = buckets.filter(F.size("samples") > 0)
    follows = F.lead("bucket").over(w) == F.col("bucket") + 1
    after = F.when(follows, F.lead(F.struct("samples", "start_byte", "end_byte")).over(w))
    rows = some.withColumn("after", after).withColumn("at", F.col("bucket") * F.lit(float(width)))
    n = F.size("samples")
    both = F.concat("samples", F.coalesce("after.samples", F.array().cast("array<float>")))
    steps = F.sequence(F.ceil((F.col("at") - 1e-9) / hop).cast("long"), F.ceil((F.col("at") + width - 1e-9) / hop).cast("long") - 1)
    rows = rows.withColumns({"both": both, "n": n, "step": F.explode(steps)})
    rows = rows.withColumn("offset", F.greatest(F.lit(0.0), F.round((F.col("step") * hop - F.col("at")) * rate)).cast("int"))
    rows = rows.filter(F.col("offset") + need <= F.size("both"))

    def byte(first: Column, last: Column, share: Column) -> Column:
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
        known = (first >= 0) & (last >= first)
        return F.when(known, first + F.round((last - first) * inside).cast("long")).otherwise(F.lit(-1).cast("long"))

    end = F.col("offset") + need
    tail = byte(F.col("after.start_byte"), F.col("after.end_byte"), (end - F.col("n")) / F.size("after.samples"))
    return rows.select(
        "source_id",
        (F.col("step") * F.lit(float(hop))).alias("start_s"),
        (F.col("step") * F.lit(float(hop)) + F.lit(float(width))).alias("end_s"),
        byte(F.col("start_byte"), F.col("end_byte"), F.col("offset") / F.col("n")).alias("start_byte"),
        F.when(end <= F.col("n"), byte(F.col("start_byte"), F.col("end_byte"), end / F.col("n"))).otherwise(tail).alias("end_byte"),
        AudioExtractor().column(F.slice("both", F.col("offset") + 1, need)).alias("values"),
    )
