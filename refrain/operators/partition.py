"""Byte ranges of whole transport packets that cover a source without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET = 188
RANGE = "array<struct<start:bigint,end:bigint,t0:double,t1:double,kind:string>>"


def packet_ranges(segments: DataFrame, sources: DataFrame, packet: int = PACKET) -> DataFrame:
    """source_id, part (from 1), start, end (exclusive), t0, t1, kind (programme or between).

    segments(source_id, start_byte, end_byte, start_s, end_s) are widened to whole packets and
    clipped to what the earlier ones leave; sources(source_id, size, duration) are covered whole.
    An ordered fold, because a segment's times are clipped to those kept before it.
    """
    clip = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, F.col("size")))
    rows = segments.join(sources, "source_id").select("source_id", clip(F.col("start_byte")).alias("start"), clip(F.col("end_byte")).alias("end"), "start_s", "end_s")
    rows = rows.filter("end > start")
    lists = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "start_s", "end_s"))).alias("all"))
    asked = sources.join(lists, "source_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,end:bigint,start_s:double,end_s:double>>")))
    size, duration = F.col("size").cast("long"), F.col("duration").cast("double")

    def one(start: Column, end: Column, t0: Column, t1: Column, kind: str) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), t0.alias("t0"), t1.alias("t1"), F.lit(kind).alias("kind")))

    def step(state: Column, x: Column) -> Column:
        floor = F.floor(x["start"] / packet).cast("long") * packet
        start = F.greatest(state["at"], F.least(size, floor))
        end = F.greatest(start, F.least(size, F.ceil(x["end"] / packet).cast("long") * packet))
        t0 = F.greatest(state["time"], F.least(duration, x["start_s"]))
        t1 = F.greatest(t0, F.least(duration, x["end_s"]))
        gap = F.when(start > state["at"], F.concat(state["out"], one(state["at"], start, state["time"], t0, "between"))).otherwise(state["out"])
        full = end > start
        return F.struct(
            F.when(full, end).otherwise(F.greatest(state["at"], start)).alias("at"),
            F.when(full, t1).when(start > state["at"], t0).otherwise(state["time"]).alias("time"),
            F.when(full, F.concat(gap, one(start, end, t0, t1, "programme"))).otherwise(gap).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("time"), F.array().cast(RANGE).alias("out"))
    done = asked.withColumn("s", F.aggregate("all", zero, step))
    tail = F.when(F.col("s.at") < size, F.concat("s.out", one(F.col("s.at"), size, F.col("s.time"), duration, "between"))).otherwise(F.col("s.out"))
    parts = done.select("source_id", F.posexplode(tail).alias("n", "r"))
    return parts.select("source_id", (F.col("n") + 1).alias("part"), "r.start", "r.end", "r.t0", "r.t1", "r.kind")
