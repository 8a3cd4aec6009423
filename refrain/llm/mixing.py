"""Operator 5, mixing sources to target weights: Pareto order sampling.

A source's target words over its size is the number of copies that its documents should have on the
average. The whole part is certain for every document. The words that then remain are drawn: a document's
inclusion probability rises with the square root of its size, scaled so that the expected words are
the remaining ones; where that reaches 1, another copy is certain too. The others are ranked by
odds(U) / odds(probability), U uniform by a hash of the document, and taken from the smallest until
the words are met. Equal rows are told apart by their number among each other.

The cut in that order is found without sorting a source in one task: two rounds of sums over
1024 ranges of the rank narrow it to a millionth of the range, and only the rows there are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refrain.llm.scratch import Scratch, read

WORD = r"[^\x20\x09-\x0D]+"
U_BITS = 60


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform_bits(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that depend on the document only, so that reruns agree."""
    return hash_bits(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources(source, source_size) -> also weight, target.

    A target is min(most * source_size, level * weight), where the level makes the targets add
    up to share * all sizes: what is above a source's limit is shared again by weight. The
    windows below run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", w.cast("long"))
    full = Window.orderBy((most * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        ranked.withColumn("sum_size", F.sum("source_size").over(upto) - F.col("source_size"))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("level", (share * F.col("all_size") - most * F.col("sum_size")) / F.col("rest_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
        .withColumn("common", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(every))
    )
    limit = most * F.col("source_size")
    target = F.when(F.col("common").isNull(), limit).otherwise(F.least(limit, F.col("common") * F.col("weight")))
    return stepped.select("source", "source_size", "weight", target.cast("double").alias("target"))


def draw_rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``rate``: a document's inclusion probability is least(1, rate * weight of its size).

    The expected words, sum(probability * size), are the source's ``rest``. Weights are whole
    numbers, so that the sums are exact; the windows run over the distinct weights of a source.
    """
    by = sized.filter("size > 0").groupBy("source", draw_weight(F.col("size")).alias("w")).agg(F.sum("size").alias("words"))
    by = by.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    heavy = Window.partitionBy("source").orderBy(F.col("w").desc())
    certain = F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("w") * F.col("words")).over(heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fits = by.withColumn("rate", (F.col("rest") - certain) / others).filter("rate * w <= 1 AND rate > 0")
    rates = fits.groupBy("source").agg(F.max_by("rate", "w").alias("rate")).withColumnRenamed("source", "s")
    return plan.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def draw_weight(size: Column) -> Column:
    return F.floor(F.sqrt(size)).cast("long")


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q), which lies in 0..1 in the same order; 0 for what is certain."""
    x = (u.cast("double") + F.lit(0.5)) / F.lit(float(2**U_BITS))
    return F.when(p >= 1, F.lit(0.0)).otherwise(x * (1 - p) / (x * (1 - p) + p * (1 - x)))


def told_apart(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """sized, where the second and later of equal rows (of one k and u) get a u of their own.

    A row's number among its equals is its number in the part of the table that it was written with
    and the count of the parts before: equal rows need not meet in one task.
    """
    rows = sized.select("k", "u", "at", F.shiftright("at", 33).alias("part"))
    twice = rows.groupBy("k", "u").agg(F.count("*").alias("n")).filter("n > 1").select("k", "u")
    equal = scratch.table(rows.join(twice, ["k", "u"]), "equal")
    if equal.isEmpty():
        return sized
    parts = equal.groupBy("k", "u", "part").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("k", "u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("k", "u", "part", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"))
    local = equal.withColumn("i", F.row_number().over(Window.partitionBy("k", "u", "part").orderBy("at")))
    numbers = local.join(before, ["k", "u", "part"]).select("at", (F.col("before") + F.col("i")).alias("i")).filter("i > 1")
    again = hash_bits(F.concat_ws("|", F.col("u").cast("string"), F.col("i").cast("string")))
    return sized.join(numbers, "at", "left").withColumn("u", F.when(F.col("i").isNull(), F.col("u")).otherwise(again)).drop("i")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, then keep.

    Sources by code point (null last, a source like any other) get the weights in turn. Null and
    empty texts have size 0 and are never taken. ``copies`` is 0, 1 or 2 at the default limit.
    A source's taken words are within half a document of its target. Equal rows are drawn each.
    Columns not named in keep are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size, u = word_count(F.col("text")), uniform_bits(F.col("doc_id"), F.col("text"), seed)
    k = F.xxhash64("source", "doc_id", "text")
    sized = docs.select("doc_id", "source", size.alias("size"), u.alias("u"), k.alias("k"), F.monotonically_increasing_id().alias("at"), *keep)
    sized = told_apart(scratch.table(sized, "sized"), scratch)
    plan = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.table(draw_rates(sized, plan), "plan")
    goal = plan.filter("rate IS NOT NULL").select(F.col("source").alias("s"), "rate", "rest")

    # The cut among 1024 ranges of the rank, then among 1024 ranges of that one, then among its rows.
    rank = pareto_rank(F.col("u"), F.least(F.lit(1.0), F.col("rate") * draw_weight(F.col("size"))))
    same = F.col("source").eqNullSafe(F.col("s"))
    ranked = sized.select("doc_id", "source", "size", "u").filter("size > 0").join(F.broadcast(goal) if _few(goal) else goal, same).withColumn("rank", rank)
    ranges = [F.floor(F.col("rank") * 2**10), F.floor(F.col("rank") * 2**20)]
    cut = None
    for i, b in enumerate(ranges):
        rows = ranked.withColumn("b", b)
        if cut is not None:
            rows = rows.join(cut.select(F.col("s").alias("t"), "cut"), F.col("source").eqNullSafe(F.col("t")) & (ranges[i - 1] == F.col("cut")), "left_semi")
        sums = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
        before = goal.select("s", "rest", F.lit(0).cast("long").alias("done")) if cut is None else cut.drop("cut")
        ordered = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.col("done") + F.col("upto")
        cut = (
            sums.withColumn("upto", F.sum("words").over(ordered))
            .join(before, same)
            .filter((upto - F.col("words") <= F.col("rest")) & (F.col("rest") < upto))
            .select("s", "rest", (upto - F.col("words")).alias("done"), F.col("b").alias("cut"))
        )
        cut = scratch.table(cut, f"cut{i}")
    here = F.struct("rank", "u", "doc_id", "size")
    upto = Window.partitionBy("s").orderBy("rank", "u", "doc_id", "size")
    edge = ranked.drop("s", "rest", "rate").join(cut, same & (ranges[1] == F.col("cut"))).withColumn("upto", F.col("done") + F.sum("size").over(upto))
    near = edge.filter((F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") <= F.col("rest") - F.col("upto") + F.col("size")))
    near = near.groupBy("s").agg(F.max(here).alias("last"))
    ends = plan.join(cut.select("s", "cut"), same, "left").drop("s").join(near, same, "left")
    ends = scratch.table(ends.select(F.col("source").alias("s"), "source_size", "target", "whole", "rate", "cut", "last"), "ends")
    drawn = (
        F.when(F.col("rate").isNull(), False)
        .when(F.col("cut").isNull(), True)
        .otherwise((ranges[1] < F.col("cut")) | ((ranges[1] == F.col("cut")) & F.coalesce(here <= F.col("last"), F.lit(False))))
    )
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + drawn.cast("long")).cast("long")
    return sized.join(ends, same).withColumn("rank", rank).select(
        "doc_id", "source", "size", F.col("source_size"), "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep
    )


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one narrow row per source, already written, is small enough to broadcast."""
    return sources.limit(most + 1).count() <= most


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
