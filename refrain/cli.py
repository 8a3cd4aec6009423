"""Command line: init, info, configure, ingest and scan of WAV and Y4M recordings against a catalogue."""

from __future__ import annotations

import argparse
import json
import math
import re
import sys
import time
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.features import AudioExtractor, VideoExtractor
from refrain.functions.naming import source_id
from refrain.operators.buckets import LONGEST_SECONDS, audio_windows, byte_envelope, video_buckets
from refrain.operators.search import base_vectors
from refrain.operators.timestamps import repaired
from refrain.options import CONTENT_TYPES, AnalyzerOptions, InferenceOptions, SearchOptions
from refrain.plans.report import dumps, scan_report
from refrain.plans.scan import scan
from refrain.sources.catalog import Catalog
from refrain.sources.media import counters, scan_audio, scan_video
from refrain.sources.store import checkpointed

FLAGS = {
    "threshold": (SearchOptions, "minimum_similarity"), "top-k": (SearchOptions, "top_k"), "min-duration": (SearchOptions, "minimum_duration_seconds"),
    "offset-bin": (SearchOptions, "offset_bin_seconds"), "max-gap": (SearchOptions, "maximum_anchor_gap_seconds"), "min-anchors": (SearchOptions, "minimum_anchors"),
    "programme-min": (InferenceOptions, "minimum_programme_seconds"), "short-repeat-max": (InferenceOptions, "maximum_short_repeat_seconds"),
    "ad-block-gap": (InferenceOptions, "ad_block_gap_seconds"), "ad-break-min": (InferenceOptions, "minimum_ad_break_seconds"),
    "ad-min-occurrences": (InferenceOptions, "minimum_ad_occurrences"), "ad-min-families": (InferenceOptions, "minimum_ad_families"),
    "alignment-tolerance": (InferenceOptions, "feature_alignment_tolerance_seconds"), "programme-audio-threshold": (InferenceOptions, "minimum_audio_similarity"),
    "programme-video-threshold": (InferenceOptions, "minimum_video_similarity"), "programme-confirm-margin": (InferenceOptions, "audio_video_confirmation_margin"),
    "marker-max": (InferenceOptions, "maximum_marker_seconds"), "marker-min-occurrences": (InferenceOptions, "minimum_marker_occurrences"),
    "audio-hop": (AnalyzerOptions, "audio_hop_seconds"), "timestamp-jump": (AnalyzerOptions, "timestamp_jump_threshold_seconds"), "mode": (AnalyzerOptions, "mode"),
}


def strict(kind: type):
    """Parses a whole number or a finite one, written plainly: no blanks, underscores, nan or inf."""

    def parse(text: str):
        if not re.fullmatch(r"[+-]?\d+" if kind is int else r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text, re.ASCII):
            raise ValueError(text)
        value = kind(text)
        if not math.isfinite(value):
            raise ValueError(text)
        return value

    parse.__name__ = kind.__name__  # for argparse's message
    return str if kind is str else parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refrain")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "info", "configure", "ingest", "scan"):
        c = sub.add_parser(name)
        c.add_argument("--db", required=name != "scan")
        if name != "info":
            c.add_argument("--max-recordings", type=strict(int), required=name == "configure")
        if name in ("ingest", "scan"):
            c.add_argument("--input", required=True)
            c.add_argument("--content-type", choices=CONTENT_TYPES, default="recording" if name == "scan" else "unknown")
            c.add_argument("--output")
            for flag, (cls, field) in FLAGS.items():
                kind = {f.name: f.default for f in fields(cls)}[field]
                c.add_argument(f"--{flag}", dest=f"{cls.__name__}.{field}", type=strict(type(kind)))
        if name == "scan":
            for flag in ("store", "no-self", "no-programme-inference", "no-timestamp-repair"):
                c.add_argument(f"--{flag}", action="store_true")
    return p


def options(args: argparse.Namespace, cls: type, **more):
    given = {k.split(".")[1]: v for k, v in vars(args).items() if k.startswith(cls.__name__ + ".") and v is not None}
    return cls(**given, **more)


@dataclass(frozen=True)
class Analysed:
    """What was read: recordings, their buckets and audio windows, clock jumps, and counted errors by recording."""

    recordings: DataFrame
    buckets: DataFrame
    windows: DataFrame
    jumps: DataFrame


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_id", source_id(F.concat("source_path", F.col("size").cast("string"))))


def analysed(spark: SparkSession, path: str, content_type: str, o: AnalyzerOptions) -> Analysed:
    """The recordings at path: a file, or a folder of files. Frames' clocks are repaired if the options say so.

    Broken frames and files are counted and left out; a file without any readable part is left out of the rest.
    """
    sound = _named(scan_audio(spark, path, o)) if o.mode != "video" else None
    sight = _named(scan_video(spark, path, o)) if o.mode != "audio" else None
    width = F.lit(o.bucket_seconds)
    parts, errors, audio, video, jumps, windows = [], [], None, None, None, None
    if sound is not None:
        errors.append(counters(sound))
        good = sound.filter("NOT is_corrupt")
        parts.append(good.select("source_id", "source_path", "size", "duration"))
        audio = good.select("source_id", "bucket", "duration", "start_byte", "end_byte", AudioExtractor().column(F.col("samples")).alias("audio"))
        windows = audio_windows(good, o)
    if sight is not None:
        errors.append(counters(sight))
        # Broken frames take part in the repair by their place, which keeps the clock going.
        timed = checkpointed(repaired(sight.filter("seq >= 0").select("source_id", F.lit("video").alias("stream"), "seq", "raw_s", "frame_s"), o))
        jumps = timed.filter("event IS NOT NULL")
        good = sight.filter("NOT is_corrupt").join(timed.select("source_id", "seq", F.col("out_s").alias("t")), ["source_id", "seq"])
        good = good.withColumn("t", F.when(F.col("t") > LONGEST_SECONDS, F.raise_error(F.lit("a recording is longer than seven days")).cast("double")).otherwise(F.col("t")))
        ends = good.groupBy("source_id", "source_path", "size").agg(F.max(F.col("t") + F.col("frame_s")).alias("duration"))
        parts.append(ends)
        frames = good.select("source_id", "seq", "t", VideoExtractor().column(F.col("gray")).alias("feature"))
        place = F.greatest(F.lit(0).cast("long"), F.floor(F.col("t") / width))
        low, high = byte_envelope(F.col("start_byte"), F.col("end_byte") - F.col("start_byte") + 1)
        extent = good.withColumn("bucket", place).groupBy("source_id", "bucket").agg(low.alias("start_byte"), high.alias("end_byte"))
        video = extent.join(video_buckets(frames, o), ["source_id", "bucket"]).join(ends.select("source_id", "duration"), "source_id")
    empty = F.lit(None).cast("array<float>")
    sides = [x for x in (audio.withColumn("video", empty) if audio is not None else None, video.withColumn("audio", empty) if video is not None else None) if x is not None]
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    at = F.col("bucket") * width
    buckets = rows.select("source_id", at.alias("start_s"), F.least(at + width, F.col("duration")).alias("end_s"), "start_byte", "end_byte", "video", "audio")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counted = errors[0] if len(errors) == 1 else errors[0].unionByName(errors[1])
    counted = counted.groupBy("source_id").agg(F.sum("decode_errors").alias("decode_errors"))
    recordings = every.groupBy("source_id", "source_path", "size").agg(F.max("duration").alias("duration")).join(counted, "source_id", "left")
    recordings = recordings.withColumns({"source_name": F.lit(""), "source_type": F.lit(content_type), "decode_errors": F.coalesce("decode_errors", F.lit(0))})
    nothing = "source_id string, stream string, seq long, raw_s double, out_s double, event string, previous_raw_s double"
    return Analysed(recordings, buckets, windows, jumps if jumps is not None else spark.createDataFrame([], nothing))


def reports(spark: SparkSession, found: Analysed, catalog: Catalog | None, search: SearchOptions, inference: InferenceOptions | None, store: bool = False, most: int | None = None) -> list[dict]:
    """Scans what was read and describes each recording; the matches of all come to the driver in one job each."""
    before = catalog.vectors().count() if catalog is not None and catalog.exists() else 0
    queries = base_vectors(found.recordings, found.buckets, found.windows)
    matches, result, _ = scan(found.recordings, queries, catalog, search, inference, found.buckets, store, most)
    after = catalog.vectors().count() if store else None
    out = []
    for media in found.recordings.orderBy("source_path").collect():
        own = lambda df, s=media["source_id"]: df.filter(F.col("source_id") == s)
        part = None if inference is None else type(result)(own(result.families), own(result.timeline), own(result.guesses))
        about = media.asDict() | {"discontinuities": [r.asDict() for r in own(found.jumps).orderBy("seq").collect()]}
        out.append(scan_report(about, own(matches), before, part, after))
    return out


def file_report(spark: SparkSession, path: str, params: tuple[str, ...]) -> dict:
    """The report of one file with extra options of ``scan``, for the cutter."""
    args = parser().parse_args(["scan", "--input", path, *params])
    inference = None if args.no_programme_inference else options(args, InferenceOptions)
    found = analysed(spark, path, args.content_type, options(args, AnalyzerOptions, **repair(args)))
    rows = reports(spark, found, Catalog(spark, args.db) if args.db else None, options(args, SearchOptions, **internal(args)), inference, args.store, args.max_recordings)
    if len(rows) != 1:
        raise ValueError(f"{path} cannot be decoded")
    return rows[0]


def repair(args: argparse.Namespace) -> dict:
    return {"repair_timestamp_discontinuities": False} if getattr(args, "no_timestamp_repair", False) else {}


def internal(args: argparse.Namespace) -> dict:
    return {"find_internal_duplicates": False} if getattr(args, "no_self", False) else {}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("refrain").getOrCreate()
    try:
        if args.command in ("ingest", "scan"):
            search = options(args, SearchOptions, **internal(args))
            inference, analyser = options(args, InferenceOptions), options(args, AnalyzerOptions, **repair(args))
            for o in (analyser, search, inference):
                print(f"{type(o).__name__}: {json.dumps(asdict(o))}", file=sys.stderr)
        catalog = Catalog(spark, args.db) if args.db else None
        if args.command == "init":
            catalog.create(args.max_recordings or 0)
        elif args.command == "info":
            print(json.dumps(catalog.info()))
        elif args.command == "configure":
            catalog.configure(args.max_recordings)
        else:
            found = analysed(spark, args.input, args.content_type, analyser)
            if args.command == "ingest":
                if not catalog.exists():
                    catalog.create(args.max_recordings or 0)
                elif args.max_recordings is not None:
                    catalog.configure(args.max_recordings)
                evicted = catalog.replace_sources(base_vectors(found.recordings, found.buckets, found.windows), found.recordings.select("source_id"))
                print(json.dumps({"evicted": [r[0] for r in evicted.collect()]}))
                return 0
            if catalog is not None and not catalog.exists() and not args.store:
                raise FileNotFoundError(args.db)
            if args.store and catalog is None:
                raise ValueError("--store needs --db")
            began = time.time()
            rows = reports(spark, found, catalog, search, None if args.no_programme_inference else inference, args.store, args.max_recordings)
            text = "".join(map(dumps, rows))
            media = sum(r["input"]["duration_seconds"] or 0 for r in rows)
            print(f"{len(rows)} recordings, {media:.0f} s of media in {time.time() - began:.0f} s", file=sys.stderr)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                sys.stdout.write(text)
    except (ValueError, OSError) as e:
        print(f"refrain: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
