"""Registered queries over the driver's tables and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.functions import lsh
from refrain.functions.features import AudioExtractor, VideoExtractor
from refrain.functions.naming import part_name, source_id
from refrain.functions.vectors import normalised, quantised, squared_norm
from refrain.operators.align import deduplicated, offset_bin, spans
from refrain.operators.buckets import byte_envelope, hopping, tumbling
from refrain.operators.components import connected_components
from refrain.operators.families import confirmed_ids, equivalent_edges, families, nodes, selected
from refrain.operators.intervals import blocks, complement, merged, union_coverage
from refrain.operators.partition import packet_ranges
from refrain.operators.search import (
    SPACE,
    base_vectors,
    catalogue_anchors,
    exact_top_k,
    hash_rows,
    lsh_candidates,
    lsh_top_k,
    self_anchors,
    similar_pairs,
    stored,
)
from refrain.operators.timeline import as_of_markers, byte_lookup, edge_statistics, evidence_blocks, infer, merged_proposals, paired_markers
from refrain.operators.timestamps import repaired
from refrain.options import InferenceOptions, SearchOptions
from refrain.plans.fixtures import event_matches, intervals, recording_catalogue, recording_vectors, table, vectors
from refrain.plans.oracle import ORACLE
from refrain.plans.report import match_json
from refrain.plans.scan import ANCHOR, duplicates
from refrain.sources.catalog import counters, retained, upserted
from refrain.sources.store import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEARCH = SearchOptions()
INFER = InferenceOptions()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


@query
def vec_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", six(F.sqrt(squared_norm(F.col("embedding")))).alias("norm"))


@query
def vec_quantize(spark, sf):
    q = quantised(normalised(F.col("embedding")))
    total = lambda f: F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + f(x.cast("long")))
    return table(spark, sf, "embeddings").select("vec_id", q.alias("q")).select("vec_id", total(lambda x: x).alias("sum_q"), total(lambda x: x * x).alias("sum_q2"))


@query
def cosine_pairs(spark, sf):
    pairs = similar_pairs(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.3)
    return pairs.select("a", "b", six("cosine").alias("cosine"))


@query
def asym_topk(spark, sf):
    v = vectors(spark, sf)
    hits = exact_top_k(v, stored(v, F.col("source_id").cast("long")), 5, 0.2)
    return hits.select(F.col("source_id").cast("long").alias("vec_id"), F.col("ref_source_id").cast("long").alias("ref_id"), F.col("rank").cast("long").alias("rank"), six("similarity").alias("similarity"))


def _rec(spark, sf, spaces=1):
    q = recording_vectors(spark, sf, spaces)
    return q, recording_catalogue(q)


@query
def topk_exclude_own(spark, sf):
    return catalogue_anchors(*_rec(spark, sf), SEARCH).select("source_id", "start_s", "ref_source_id", "ref_start_s", six("similarity").alias("similarity"))


@query
def extractor_compat(spark, sf):
    hits = exact_top_k(*_rec(spark, sf, 2), 12, 0.985)
    return hits.groupBy("source_id", "extractor_id", "ref_source_id").agg(F.count("*").alias("hits"))


@query
def base_vectors_union(spark, sf):
    s = F.col("id")
    two = lambda a, b: F.array(a.cast("float"), b.cast("float"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("region"))
    name = F.concat(F.lit("source-"), F.col("region"))
    media = r.select(name.alias("source_id"), F.lit("").alias("source_name"), F.lit("synthetic.ts").alias("source_path"), F.lit("advertisement").alias("source_type"))
    b = r.join(spark.range(20), how="cross").select(
        name.alias("source_id"), s.cast("double").alias("start_s"), (s + 1).cast("double").alias("end_s"), (s * 1000).alias("start_byte"), (s * 1000 + 999).alias("end_byte"),
        F.when(s != 7, two(s % 10 + 1, s * 3 % 10 + 1)).alias("video"), F.when(s != 3, two(s % 10 + 2, s * 7 % 10 + 1)).otherwise(two(F.lit(0), F.lit(0))).alias("audio"),
    )
    w = r.filter("region % 2 = 0").join(spark.range(2), how="cross").select(
        name.alias("source_id"), (s * 0.5).cast("double").alias("start_s"), (s * 0.5 + 1).cast("double").alias("end_s"), F.lit(0).cast("long").alias("start_byte"), F.lit(999).cast("long").alias("end_byte"), two(F.lit(1), F.lit(2)).alias("values")
    )
    return base_vectors(media, b, w).select("source_id", "kind", "start_s", "end_s", six(F.element_at("values", 1)).alias("v1"), six(F.element_at("values", 2)).alias("v2"))


def _total(numbers):
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


@query
def video_feature(spark, sf):
    """Features of every page's first 576 bytes as a grey picture; shorter ones are filled with zeros."""
    gray = F.substring(F.rpad(F.to_binary(F.coalesce("html", F.lit("")), F.lit("utf-8")), 576, F.to_binary(F.lit("00"), F.lit("hex"))), 1, 576)
    v = VideoExtractor().column(gray)
    wide = F.transform("v", lambda x: x.cast("double"))
    return table(spark, sf, "pages").select("page_id", v.alias("v")).select(
        "page_id", F.round(F.element_at(wide, 1), 5).alias("mean_level"), F.round(_total(F.transform(wide, lambda x: x * x)), 4).alias("norm2"), F.size("v").alias("dim"),
        F.round(_total(F.slice(wide, 2, 63)), 5).alias("waves"), F.round(_total(F.slice(wide, 113, 16)), 5).alias("edges"),
        F.round(_total(F.transform(wide, lambda x, i: x * (i + 1))), 3).alias("moment"),
    )


@query
def audio_feature(spark, sf):
    """Features of every embedding as if its numbers were samples."""
    v = AudioExtractor().column(F.col("embedding"))
    wide = F.transform("v", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select(
        "vec_id", F.round(_total(F.transform(wide, lambda x: x * x)), 4).alias("norm2"), F.size("v").alias("dim"),
        F.round(_total(F.slice(wide, 1, 24)), 5).alias("levels"), F.round(_total(F.slice(wide, 121, 8)), 5).alias("shape"),
        F.round(_total(F.transform(wide, lambda x, i: x * (i + 1))), 3).alias("moment"),
    )


@query
def block_extents(spark, sf):
    """First start and last end of each family in each block."""
    x = _ad_rows(spark, sf).groupBy("source_id", "block", "family").agg(six(F.min("start_s")).alias("start_s"), six(F.max("end_s")).alias("end_s"))
    return x.select("source_id", "block", "family", "start_s", "end_s")


@query
def lsh_signature(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("unit", normalised(F.col("embedding")))
    return hash_rows(e, "unit", ["vec_id"]).select("vec_id", F.col("table").cast("long").alias("tab"), "hash")


def _probes(spark, sf, fewest):
    e = table(spark, sf, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("unit")).withColumns({"extractor_id": F.lit("e"), "kind": F.lit("k"), "dim": F.size("unit"), "q": quantised(F.col("unit"))})
    pairs = lsh_candidates(e.withColumnRenamed("vec_id", "query"), e.withColumnRenamed("vec_id", "ref"), list(SPACE), fewest)
    return pairs.groupBy("query").agg(F.count("*").alias("n"), F.sum("ref").alias("sum_ref")).withColumnRenamed("query", "vec_id")


@query
def lsh_probe(spark, sf):
    return _probes(spark, sf, None)


@query
def lsh_widen(spark, sf):
    return _probes(spark, sf, 64)


@query
def lsh_topk(spark, sf):
    """Hits of the hashed search: at this similarity a vector is missed once in ten thousand times."""
    hits = lsh_top_k(*_rec(spark, sf), 12, 0.985)
    return hits.groupBy("source_id").agg(F.count("*").alias("hits"))


@query
def self_repeat_anchors(spark, sf):
    o = SearchOptions(minimum_similarity=0.3)
    return self_anchors(recording_vectors(spark, sf), o).select("source_id", "start_s", "ref_start_s", six("similarity").alias("similarity"))


def _anchors(spark, sf):
    return catalogue_anchors(*_rec(spark, sf), SEARCH).select(*ANCHOR)


@query
def offset_bins(spark, sf):
    shift = offset_bin((F.col("ref_start_s") - F.col("start_s")) / 2, 1.0)
    return _anchors(spark, sf).withColumn("bin", shift).groupBy("source_id", "ref_source_id", "bin").agg(F.count("*").alias("anchors"))


@query
def anchor_dedupe(spark, sf):
    wide = SearchOptions(offset_bin_seconds=20.0)
    return deduplicated(_anchors(spark, sf), wide).select("source_id", "ref_source_id", "offset_bin", "start_s", "ref_start_s")


SPAN = ("source_id", "reference_id", "kind", "offset_bin", "q_start", "q_end", "r_start", "r_end", "anchor_count", "q_start_byte", "q_end_byte", "r_start_byte", "r_end_byte")


@query
def aligned_spans(spark, sf):
    return spans(_anchors(spark, sf), SEARCH).select(*SPAN, six("similarity").alias("similarity"))


@query
def scan_spans(spark, sf):
    return duplicates(*_rec(spark, sf), SEARCH).select(*SPAN, six("similarity").alias("similarity"))


@query
def av_confirm(spark, sf):
    return confirmed_ids(event_matches(spark, sf), INFER)


def _media(matches):
    return matches.select("source_id").distinct().select("source_id", F.lit("p").alias("source_path"), F.lit("recording").alias("source_type"), F.lit(700.0).alias("duration"))


@query
def match_selection(spark, sf):
    return selected(event_matches(spark, sf), INFER).select("match_id", "confirmed")


@query
def occurrence_edges(spark, sf):
    m = event_matches(spark, sf)
    return equivalent_edges(nodes(m, _media(m)), 3.0)


@query
def content_components(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("a"))
    return connected_components(d.join(first, "h").filter("doc_id != a").select("a", F.col("doc_id").alias("b")))


def _found(spark, sf):
    spans_found = checkpointed(duplicates(*_rec(spark, sf), SEARCH).withColumns({"match_id": F.monotonically_increasing_id(), "kind": F.lit("audio_spectrum")}))
    return spans_found, _media(spans_found)


@query
def family_stats(spark, sf):
    out = families(*_found(spark, sf), INFER)
    return out.select("source_id", "family_id", "classification", "known_type", six("confidence").alias("confidence"), "typical", F.size("occurrences").alias("occurrences"))


@query
def timeline_labels(spark, sf):
    out = infer(*_found(spark, sf), INFER).timeline
    return out.select("source_id", "seg", "label", "start_s", "end_s", six("confidence").alias("confidence"), six("repeat_coverage").alias("repeat_coverage"), "family_count")


@query
def interval_blocks(spark, sf):
    b = blocks(intervals(spark, sf), ["k"], 600.0, ("event_id",))
    return b.groupBy("k", "block").agg(six(F.min("start_s")).alias("start_s"), six(F.max("end_s")).alias("end_s"), F.count("*").alias("n"))


@query
def interval_union(spark, sf):
    m = merged(intervals(spark, sf, "event_type"), ["k"])
    return m.groupBy("k").agg(F.count("*").alias("parts"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 3).alias("seconds"))


def _days(spark, sf):
    keys = intervals(spark, sf, "event_type").select("k").distinct()
    return keys.join(spark.range(30), how="cross").select("k", F.col("id").alias("seg"), (F.col("id") * 86400.0).alias("start_s"), ((F.col("id") + 1) * 86400.0).alias("end_s"))


@query
def union_coverage_days(spark, sf):
    i = intervals(spark, sf, "event_type").select("k", F.col("start_s").alias("i0"), F.col("end_s").alias("i1"))
    return union_coverage(_days(spark, sf), i, ["k"]).select("k", "seg", six("coverage").alias("coverage"))


def _ad_rows(spark, sf):
    rows = intervals(spark, sf).withColumnRenamed("k", "source_id").withColumns({"family": (F.col("event_id") % 7).cast("long"), "confidence": F.lit(0.8) + (F.col("event_id") % 3) * 0.05, "confirmed": F.col("event_id") % 4 == 0, "known_ad": F.col("event_id") % 11 == 0})
    return blocks(rows, ["source_id"], 3000.0, ("family", "event_id"))


LONG = InferenceOptions(maximum_short_repeat_seconds=20_000.0)


@query
def ad_blocks(spark, sf):
    return evidence_blocks(_ad_rows(spark, sf), LONG).select("source_id", "block", six("start_s").alias("start_s"), six("end_s").alias("end_s"), six("confidence").alias("confidence"), "confirmed", "known_ad", "families")


@query
def edge_stats(spark, sf):
    return edge_statistics(_ad_rows(spark, sf), LONG)


def _markers(spark, sf):
    rows = intervals(spark, sf).filter("event_type IN ('click', 'view', 'purchase')")
    return rows.select(F.col("k").alias("source_id"), F.col("start_s").alias("m_start"), F.col("end_s").alias("m_end"), F.col("event_id").alias("family"), F.concat(F.lit("f"), "event_id").alias("family_id"), (F.col("event_id") % 2 == 0).alias("out"), F.lit(True).alias("catalogue"), F.lit(0.9).alias("m_confidence"))


MARK = InferenceOptions(feature_alignment_tolerance_seconds=7200.0, ad_block_gap_seconds=14400.0, maximum_short_repeat_seconds=100_000.0)


@query
def asof_marker(spark, sf):
    parts = intervals(spark, sf).select(F.col("k").alias("source_id"), F.col("event_id").alias("block"), "start_s", "end_s")
    return as_of_markers(parts, _markers(spark, sf), MARK).select("source_id", "block", F.col("before.family_id").alias("before_id"), F.col("after.family_id").alias("after_id"))


@query
def next_pair(spark, sf):
    return paired_markers(_markers(spark, sf), MARK).select("source_id", "out_id", "in_id", six("start_s").alias("start_s"), six("end_s").alias("end_s"))


@query
def merge_first_last(spark, sf):
    rows = intervals(spark, sf).filter("value > 0").select(
        F.col("k").alias("source_id"), "start_s", "end_s", F.lit(0.9).alias("confidence"), (F.col("event_id") % 5 == 0).alias("exempt"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("o"), F.col("event_id"))).alias("out_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("i"), F.col("event_id"))).alias("in_id"),
    )
    return merged_proposals(rows, 7200.0).select("source_id", six("start_s").alias("start_s"), six("end_s").alias("end_s"), "exempt", "out_id", "in_id")


@query
def complement_timeline(spark, sf):
    rows = merged(intervals(spark, sf), ["k"])
    keys = rows.select("k").distinct().withColumn("duration", F.lit(30 * 86400.0))
    return complement(rows, keys, ["k"]).select("k", six("start_s").alias("start_s"), six("end_s").alias("end_s"), "preceded", "followed")


@query
def byte_at(spark, sf):
    p = table(spark, sf, "pages").select((F.col("page_id") % 7).alias("source_id"), "page_id", F.octet_length("html").cast("long").alias("n"))
    w = Window.partitionBy("source_id").orderBy("page_id")
    b = p.select("source_id", "page_id", (F.row_number().over(w) - 1).cast("double").alias("start_s"), (F.sum("n").over(w) - F.col("n")).alias("start_byte"), (F.sum("n").over(w) - 1).alias("end_byte"))
    asked = p.select("source_id", "page_id", (F.col("page_id") % 50 / 1.0 + 0.25).alias("t"), (F.col("page_id") % 50 / 1.0 + 1).alias("u"))
    out = byte_lookup(byte_lookup(asked, b, "t", "first_byte", False), b, "u", "last_byte", True)
    return out.select("source_id", "page_id", "first_byte", "last_byte")


@query
def tumbling_buckets(spark, sf):
    e = intervals(spark, sf, "event_type")
    low, high = byte_envelope(F.col("event_id") - 3, F.col("value").cast("long"))
    out = tumbling(e, ["k"], F.col("start_s"), 3600.0, {"n": F.count("*"), "low": low, "high": high})
    return out.select("k", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("low", F.lit(-1).cast("long")).alias("low"), F.coalesce("high", F.lit(-1).cast("long")).alias("high"))


@query
def hopping_windows(spark, sf):
    return hopping(intervals(spark, sf, "event_type"), ["k"], F.col("start_s"), 7200.0, 1800.0, {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


def _sources(spark, sf):
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "recording").otherwise(F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), kind.alias("source_type"), (F.col("c_custkey") % 97).alias("sequence"))


@query
def retention(spark, sf):
    return retained(_sources(spark, sf), 25)


def _stored_rows(spark, sf):
    return table(spark, sf, "orders").join(_sources(spark, sf).withColumnRenamed("source_id", "c"), F.col("o_custkey").cast("string") == F.col("c")).select(F.col("c").alias("source_id"), "source_type", F.col("o_orderpriority").alias("extractor_id"), "o_orderkey")


@query
def upsert_source(spark, sf):
    old = _stored_rows(spark, sf)
    new = old.filter("CAST(source_id AS BIGINT) % 10 = 0").withColumn("o_orderkey", -F.col("o_orderkey")).filter("o_orderkey % 2 = 0")
    return upserted(old, new)


@query
def catalog_info(spark, sf):
    return counters(_stored_rows(spark, sf))


def _cuts(spark, sf):
    p = table(spark, sf, "pages").select((F.col("page_id") % 7).alias("source_id"), "page_id", F.octet_length("html").cast("long").alias("n"))
    w = Window.partitionBy("source_id").orderBy("page_id")
    rows = p.select("source_id", "page_id", (F.sum("n").over(w) - F.col("n")).alias("start_byte"), F.sum("n").over(w).alias("end_byte"), (F.row_number().over(w) - 1).cast("double").alias("start_s"))
    sources = rows.groupBy("source_id").agg(F.max("end_byte").alias("size"), F.count("*").cast("double").alias("duration"))
    return rows.filter("page_id % 3 = 0").withColumn("end_s", F.col("start_s") + 1), sources


@query
def packet_partition(spark, sf):
    return packet_ranges(*_cuts(spark, sf)).select("source_id", "part", F.col("start").alias("first"), F.col("end").alias("last"), "kind", "t0", "t1")


@query
def part_names(spark, sf):
    n = F.col("event_id").cast("int")
    name = part_name(F.concat(F.lit("rec"), F.col("k")), n, F.col("event_type"), F.col("start_s") / 100, F.col("end_s") / 100)
    return intervals(spark, sf).select("event_id", name.alias("name"))


@query
def timestamp_repair(spark, sf):
    i = F.col("event_id")
    frames = table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("source_id"), F.when(i % 2 == 0, "audio").otherwise("video").alias("stream"), i.alias("seq"),
        F.when(i % 13 != 0, i / 10.0 + F.when(i % 101 == 0, 5000.0).otherwise(0.0)).alias("raw_s"), F.lit(0.5).alias("frame_s"),
    )
    return repaired(frames).select("source_id", "stream", "seq", six("out_s").alias("out_s"), "event")


@query
def source_id_fnv(spark, sf):
    return table(spark, sf, "pages").select("page_id", source_id(F.concat("url", F.octet_length("html"))).alias("id"))


@query
def report_json(spark, sf):
    return match_json(checkpointed(duplicates(*_rec(spark, sf), SEARCH)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
