"""Operator 2, line dedup: exact lines by hash, fuzzy lines by MinHash, one line per component.

Everything is DataFrame and SQL functions. A line's set is its distinct shingles: the eight lower-cased
characters from every position of the whole line; a line of fewer is one shingle. Lines are similar with a
Jaccard similarity of 0.75 of these sets, at any length.

Shingles are slices of the line in UTF-32, of which any is found at once. To sign lines they are rows of a
whole-stage aggregate, without an array of hashes and a function per element. The signature has 24 MinHash
values in eight bands of three; a value is the least hash after its bits are flipped by the value's constant,
thus the hash nearest to a point. With independent values that would miss 1.3 % of the pairs at a similarity of
exactly 0.75, 0.3 % at 0.8 and one in 2,000 at 0.85. Lines that share a band are candidates: every line of a band with
the band's first, then in bands where a union-find leaves components apart, the lines of different components, in blocks.
Of candidates with AGREE equal values of 24 or more, and of those with a line of fewer than LONG shingles, the full sets are
compared. Of pairs at a similarity of exactly 0.75 that share a band, fewer equal values were met in none of 20,000.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.graph import connected_components, relabelled
from refrain.llm.scratch import Scratch, read

BLANKS = " \t\n\v\f\r"
#: Characters of a shingle, bands and values of a band; places that a row signs; lines of a block;
#: further rounds with one line of a band; pairs of signatures for a line of a band, beyond which there is such a round.
WIDTH, BANDS, ROWS, STEP, BLOCK, HUBS, MANY = 8, 8, 3, 16, 256, 2, 32
POINTS = np.random.default_rng(21).integers(-(2**31), 2**31, BANDS * ROWS).tolist()
VALUES = [f"v{n}" for n in range(BANDS * ROWS)]
PLACE = ("doc_id", "row", "line_no")
#: Lines of so many shingles are not compared in full if fewer values of their signatures agree, at 75 percent.
LONG, AGREE = 24, 9


def usable(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), text of the rows that have both."""
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0), line, id, id2 (the line's hash) of every line that holds a word."""
    lines = usable(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.filter(F.ltrim("line", F.lit(BLANKS)) != "")
    return lines.select("*", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))


def code_points(line: Column) -> Column:
    """The lower-cased line, four bytes a character."""
    return F.encode(F.lower(line), "UTF-32")


def places(code: Column) -> Column:
    """Where the shingles of code_points begin."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(code) - (4 * WIDTH - 1), F.lit(1)), F.lit(4))


def hashes(line: Column) -> Column:
    """64-bit hashes of the line's shingles, in order, repeats included."""
    cut = lambda code: F.transform(places(code), lambda at: F.xxhash64(F.substring(code, at, F.lit(4 * WIDTH))))
    return F.flatten(F.transform(F.array(code_points(line)), cut))


def signed(lines: DataFrame) -> DataFrame:
    """lines(id, line) -> id, n, VALUES: how many shingles a line has, repeats included, and its signature; lines with equal sets have equal VALUES."""
    coded = lines.select("id", code_points(F.col("line")).alias("code"))
    coded = coded.select("id", "code", F.greatest(F.octet_length("code") - (4 * WIDTH - 1), F.lit(1)).alias("last"))
    rows = coded.select("id", "code", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STEP))).alias("at"))
    # A row has STEP places; those after the last shingle count that one again.
    cut = [F.hash(F.substring(F.col("code"), F.least(F.col("at") + 4 * k, F.col("last")), F.lit(4 * WIDTH))).alias(f"h{k}") for k in range(STEP)]
    least = [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(x)) for k in range(STEP)])).alias(v) for v, x in zip(VALUES, POINTS, strict=True)]
    return rows.select("id", "last", *cut).groupBy("id").agg((F.max("last") / 4).cast("int").alias("n"), *least)


def bands(signs: DataFrame) -> DataFrame:
    """id, keys: the bands of signed lines."""
    return signs.select("id", F.array(*[F.xxhash64(F.lit(k), *VALUES[k * ROWS : (k + 1) * ROWS]) for k in range(BANDS)]).alias("keys"))


def _few_lines(lines: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.createDataFrame(list(enumerate(lines)), "id long, line string")


def band_keys(lines: list[str]) -> np.ndarray:
    """[lines, BANDS] keys of a few lines, collected."""
    return np.array([r["keys"] for r in bands(signed(_few_lines(lines))).orderBy("id").collect()], np.int64).reshape(-1, BANDS)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a few lines, one line after the other, collected, and where each line's begin."""
    found = [r["h"] for r in _few_lines(lines).select("id", hashes(F.col("line")).alias("h")).orderBy("id").collect()]
    return np.concatenate(found), np.cumsum([0, *map(len, found[:-1])])


def similar(s: Column, t: Column, percent: int) -> Column:
    """Whether two sets, arrays without repeats, have 100 * intersection >= percent * union."""
    both, n, m = F.size(F.array_intersect(s, t)).cast("long"), F.size(s), F.size(t)
    return may_link(n, m, percent) & ((100 + percent) * both >= percent * (n.cast("long") + m))


def may_link(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long")


def alike(x: str, y: str, percent: int) -> Column:
    """Whether the signatures with these prefixes are of lines that may be similar enough to compare them."""
    agree = sum((F.col(f"{x}{v}") == F.col(f"{y}{v}")).cast("int") for v in VALUES)
    return (F.col(f"{x}n") < LONG) | (F.col(f"{y}n") < LONG) | (75 * agree >= AGREE * percent)


def prefixed(signs: DataFrame, x: str) -> DataFrame:
    return signs.select(*[F.col(c).alias(f"{x}{c}") for c in ("id", "n", *VALUES)])


def sifted(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose signatures are alike."""
    both = pairs.join(prefixed(signs, "x_"), F.col("a") == F.col("x_id")).join(prefixed(signs, "y_"), F.col("b") == F.col("y_id"))
    return both.filter(alike("x_", "y_", percent)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) of similar lines; dealt out by b for the comparison."""
    lines = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    lines = lines.join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    sets = lines.select("a", "b", *[F.array_distinct(hashes(F.col(f"line_{x}"))).alias(f"s{x}") for x in "ab"])
    return sets.filter(similar(F.col("sa"), F.col("sb"), percent)).select("a", "b")


def apart(rows: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of lines alike between components c in each bucket, i, j of rows(bucket, i, j, id, c, own); where i and j differ, between blocks."""
    rows = rows.join(signs, "id")
    x, y = (rows.select("bucket", "i", "j", *[F.col(c).alias(f"{p}{c}") for c in ("id", "c", "own", "n", *VALUES)]) for p in ("x_", "y_"))
    due = (F.col("x_id") < F.col("y_id")) & (F.col("x_c") != F.col("y_c")) & ((x["i"] == x["j"]) | (F.col("x_own") != F.col("y_own")))
    found = x.alias("x").join(y.alias("y"), (x["bucket"] == y["bucket"]) & (x["i"] == y["i"]) & (x["j"] == y["j"]) & due & alike("x_", "y_", percent))
    return found.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def joined(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """found(node, component) after further links(a, b)."""
    for x in "ab":
        links = links.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    links = scratch.table(links.select("a", "b", "ca", "cb"), "links")
    merged = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    ends = [links.select(F.col(x).alias("node"), F.col(f"c{x}").alias("component")) for x in "ab"]
    return relabelled(scratch.table(found.unionByName(ends[0]).unionByName(ends[1]).distinct(), "labels"), merged, scratch)


def line_components(signs: DataFrame, exact: DataFrame, docs: DataFrame, scratch: Scratch, percent: int, block: int) -> DataFrame:
    """(node, component) of the lines signs(id, n, VALUES), exact(id, first) that links join."""
    keyed = bands(signs).select("id", F.explode("keys").alias("bucket"))
    keyed = keyed.repartition("bucket")
    each = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("total")).filter("n > 1")
    # Bands with the same lines are one.
    each = each.groupBy("n", "low", "total").agg(F.min("bucket").alias("bucket")).drop("total")
    rows = scratch.table(keyed.join(each.hint("merge"), "bucket").select("bucket", "id", "n", "low"), "candidates")
    few = scratch.table(signs.join(rows.select("id").distinct(), "id", "left_semi"), "signatures")
    scratch.drop(signs)
    del keyed, each, signs
    scratch.free()

    wanted = exact.join(few.select("id"), "id", "left_semi").groupBy("id").agg(F.min("first").alias("first")).groupBy("first.doc_id", "first.row").agg(F.collect_set(F.struct("first.line_no", "id")).alias("at"))
    split = usable(docs).join(wanted, ["doc_id", "row"]).select(F.split("text", "\n", -1).alias("all"), "at")
    picked = split.select(F.explode(F.transform("at", lambda a: F.struct(a["id"].alias("id"), F.element_at("all", a["line_no"] + 1).alias("line")))).alias("x"))
    texts = scratch.table(picked.select("x.*"), "texts")
    del wanted, split, picked
    scratch.free()

    first = rows.filter("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    found = connected_components(scratch.table(confirmed(sifted(first, few, percent), texts, percent), "links"), scratch)

    live = rows.filter("n > 2")
    for k in range(HUBS + 1):
        big = live.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))
        mixed = big.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "c")).alias("hub")).filter("least < most")
        big = scratch.table(big.join(mixed.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.c").alias("hub_c")), "bucket"), "apart")
        parts = big.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.first("n").alias("n")).agg(F.sum(F.col("m") * (F.col("n") - F.col("m")) / 2))
        if k == HUBS or (parts.first()[0] or 0) <= MANY * big.count():
            break
        with_hub = big.filter("c != hub_c").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        found = joined(found, scratch.table(confirmed(sifted(with_hub, few, percent), texts, percent), "links"), scratch)
        live = big.select("bucket", "id", "n")  # other bands are one component and stay so
    if not big.isEmpty():
        dealt = big.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select("bucket", "id", "c", F.col("blocks"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        pairs = scratch.table(apart(dealt, few, percent), "pairs")
        more = scratch.table(confirmed(pairs, texts, percent), "links")
        if not more.isEmpty():
            found = joined(found, more, scratch)
    scratch.drop(rows, few, texts, big)
    return found


def removed_lines(docs: DataFrame, scratch: Scratch, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """doc_id, row, gone: the numbers of the lines that another one stands for."""
    signs = scratch.table(signed(lines_of(docs)), "signatures")
    scratch.free()
    lines, place = lines_of(docs).drop("line"), F.struct(*PLACE)
    exact = scratch.table(lines.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "exact")
    components = line_components(signs, exact, docs, scratch, percent, block)
    scratch.free()
    groups = exact.join(components.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 OR component IS NOT NULL")
    groups = groups.select("id", "id2", "first", F.coalesce("component", "id").alias("c"), F.when(F.col("component").isNull(), F.col("id2")).alias("c2"))
    groups = scratch.table(groups, "groups")
    scratch.drop(exact)
    first = groups.groupBy("c", "c2").agg(F.min("first").alias("keep")).withColumnsRenamed({"c": "d", "c2": "d2"})
    verdict = groups.join(first, (F.col("c") == F.col("d")) & F.col("c2").eqNullSafe(F.col("d2"))).select("id", "id2", "keep")
    gone = lines.select(*PLACE, "id", "id2").join(verdict, ["id", "id2"]).filter(place != F.col("keep"))
    gone = scratch.table(gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")), "gone")
    scratch.drop(groups)
    return gone


def dedup_lines(docs: DataFrame, *, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text without removed lines, n_lines, gone, then keep.

    Lines are what \\n splits. Of equal or similar lines, in one document or in many, the one with
    the smallest doc_id stays, in it the first. Lines without a word always stay. Null texts stay null, with no
    lines. Rows without doc_id are neither changed nor compared. Rows that repeat a doc_id with
    another text are documents of their own; rows that repeat both count as one. Any length of
    line or text is compared whole.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    removed = removed_lines(docs, scratch, percent)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text", *keep).join(removed, ["doc_id", "row"], "left")
    rows = rows.withColumn("gone", F.coalesce(F.sort_array("gone"), F.array().cast("array<int>")))
    parts = F.split("text", "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), "gone", *keep)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), text_sha256 of what stays."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join("gone", ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
