"""Cutting recordings: byte ranges of whole packets copied to files, resumed, checked and rolled back.

A file's parts are rows; executors copy them side by side, each to a name of its own that is renamed when
whole, so that a task that is run again or twice leaves a part complete or absent.
``python -m refrain.streaming.cutter --config folders.json --state STATE [--once]`` watches folders.
"""

from __future__ import annotations

import argparse
import json
import math
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.naming import part_name
from refrain.operators.partition import PACKET, packet_ranges
from refrain.streaming.watch import FolderConfig, parse_config, run_daemon, run_once

CHUNK = 8 << 20
SEGMENTS = "source_id string, start_byte long, end_byte long, start_s double, end_s double"
#: Maps a file and its extra options to a report (``refrain.plans.report``).
Scan = Callable[[str, tuple[str, ...]], dict]


@dataclass(frozen=True)
class Snapshot:
    """What a file was when it was looked at."""

    path: str
    size: int
    modified_ns: int


@dataclass(frozen=True)
class Outcome:
    source: Snapshot
    outputs: tuple[str, ...] = ()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def snapshot(path: str) -> Snapshot:
    at, inner = opened(path)
    info = at.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return Snapshot(path, info.size, info.mtime_ns or 0)


def split_name(path: str) -> tuple[str, str]:
    """Stem and suffix of a path's last part."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    return (stem, dot + suffix) if stem else (name, "")


def existing_parts(folder: str, source: str) -> dict[str, int]:
    """Name and size of the files in folder that are named like parts of source, in any case."""
    stem, suffix = (x.casefold() for x in split_name(source))
    at, inner = opened(folder)
    found = at.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    own = [f for f in found if f.type == fs.FileType.File and f.base_name.casefold().startswith(f"{stem}.part") and f.base_name.casefold().endswith(suffix)]
    return {f.base_name: f.size for f in sorted(own, key=lambda f: f.base_name.casefold())}


def complete(outcome: Outcome) -> bool:
    """Whether all outputs are there and as long together as the source was."""
    if not outcome.outputs:
        return False
    try:
        return sum(snapshot(path).size for path in outcome.outputs) == outcome.source.size
    except OSError:
        return False


def copy_part(source: str, target: str, start: int, end: int) -> bool:
    """Copies bytes start..end (exclusive) to a file that must be new; True if this call made it."""
    at, inner = opened(source)
    to, path = opened(target)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with at.open_input_file(inner) as read, to.open_output_stream(draft) as write:
            read.seek(start)
            left = end - start
            while left:
                block = read.read(min(CHUNK, left))
                if not block:
                    raise OSError(f"unexpected end of {source}")
                write.write(block)
                left -= len(block)
        info = to.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            to.move(draft, path)
            return True
        if info.size != end - start:
            raise FileExistsError(target)
        return False  # another attempt of this task was first
    finally:
        if to.get_file_info(draft).type != fs.FileType.NotFound:
            to.delete_file(draft)


def copy_parts(parts: DataFrame) -> DataFrame:
    """target, error of parts(source, target, start, end), copied where the rows are; error is null if all went well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            errors = []
            for r in rows.itertuples():
                try:
                    copy_part(r.source, r.target, int(r.start), int(r.end))
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"target": rows["target"], "error": pd.Series(errors, rows.index, dtype=object)})

    return parts.select("source", "target", "start", "end").mapInPandas(run, "target string, error string")


def whole(guess: dict, key: str) -> int:
    x = guess.get(key)
    if not isinstance(x, int) or isinstance(x, bool):
        raise ValueError(f"a programme guess has no {key}")
    return x


def finite(guess: dict, key: str) -> float:
    x = guess.get(key)
    if not isinstance(x, (int, float)) or isinstance(x, bool) or not math.isfinite(x):
        raise ValueError(f"a programme guess has no {key}")
    return float(x)


def planned_parts(spark: SparkSession, report: dict, source: Snapshot, folder: str) -> list[dict]:
    """The parts of a source by its report: target, start, end in order; they cover it whole."""
    guesses, about = report.get("programme_guesses"), report.get("input")
    if not isinstance(guesses, list) or not isinstance(about, dict):
        raise ValueError("the report has no programme_guesses or no input")
    duration = about.get("duration_seconds")
    if not isinstance(duration, (int, float)) or isinstance(duration, bool) or not 0 < duration <= 7 * 86400:
        raise ValueError("the report has no duration of up to seven days")
    rows = [("s", *(whole(g, k) for k in ("start_byte", "end_byte")), *(finite(g, k) for k in ("start_time_seconds", "end_time_seconds"))) for g in guesses]
    if any(a < b and t >= u for _, a, b, t, u in rows):
        raise ValueError("a programme guess ends before it starts")
    stem, suffix = split_name(source.path)
    sources = spark.createDataFrame([("s", source.size, float(duration))], "source_id string, size long, duration double")
    ranges = packet_ranges(spark.createDataFrame(rows, SEGMENTS), sources)
    name = part_name(F.lit(stem), F.col("part").cast("int"), F.col("kind"), F.col("t0"), F.col("t1"), suffix)
    parts = [r.asDict() for r in ranges.select("part", name.alias("name"), "start", "end").orderBy("part").collect()]
    if sum(p["end"] - p["start"] for p in parts) != source.size:
        raise ValueError("the parts do not cover the source")
    return [{"name": p["name"], "target": f"{folder.rstrip('/')}/{p['name']}", "start": p["start"], "end": p["end"]} for p in parts]


def process_file(spark: SparkSession, config: FolderConfig, path: str, scan: Scan, now: datetime | None = None) -> Outcome | None:
    """Scans a file and writes its parts; None where it is to be looked at again later.

    Parts that are there already stay if they are as planned; others, or a part of another size, are
    an error. After an error the parts that this call made are removed.
    """
    before = snapshot(path)
    now = now or datetime.now(timezone.utc)
    if now.timestamp() - before.modified_ns / 1e9 < config.mtime_over or before.size < PACKET:
        return None
    report = scan(path, config.params)
    if snapshot(path) != before:
        return None
    if config.output_folder is None:
        return Outcome(before)
    there = existing_parts(config.output_folder, path)
    parts = planned_parts(spark, report, before, config.output_folder)
    if other := sorted(there.keys() - {p["name"] for p in parts}):
        raise ValueError(f"parts of another cut are there: {other}")
    for p in parts:
        if there.get(p["name"], p["end"] - p["start"]) != p["end"] - p["start"]:
            raise ValueError(f"a part has another size: {p['target']}")
    to, inner = opened(config.output_folder)
    to.create_dir(inner, recursive=True)
    missing = [{"source": path, **p} for p in parts if p["name"] not in there]
    try:
        if missing:
            todo = spark.createDataFrame([(p["source"], p["target"], p["start"], p["end"]) for p in missing], "source string, target string, start long, end long")
            errors = [r["error"] for r in copy_parts(todo.repartition(len(missing))).collect() if r["error"]]
            if errors:
                raise OSError("; ".join(errors))
        outcome = Outcome(before, tuple(p["target"] for p in parts))
        if snapshot(path) != before:
            raise OSError("the source changed while it was copied")
        if not complete(outcome):
            raise OSError("the parts do not add up to the source")
        for target in outcome.outputs:
            carry_time(target, before)
        return outcome
    except BaseException:
        for p in missing:
            at, made = opened(p["target"])
            if at.get_file_info(made).type == fs.FileType.File:
                at.delete_file(made)
        raise


def carry_time(target: str, source: Snapshot) -> None:
    """Gives a part the source's time, where the store has a call for it."""
    at, inner = opened(target)
    if isinstance(at, fs.LocalFileSystem):
        import os

        os.utime(inner, ns=(source.modified_ns, source.modified_ns))


def delete_source(config: FolderConfig, outcome: Outcome) -> bool:
    """Deletes the source if the configuration says so; False where it changed and stays."""
    if not config.delete_source:
        return True
    if not complete(outcome):
        raise OSError("the source stays, its parts are incomplete")
    if snapshot(outcome.source.path) != outcome.source:
        return False
    at, inner = opened(outcome.source.path)
    at.delete_file(inner)
    return True


def handler(spark: SparkSession, scan: Scan) -> Callable[[str, FolderConfig], bool]:
    """For ``watch.run_once``: cuts a file; False where it is to be looked at again."""

    def handle(path: str, config: FolderConfig) -> bool:
        outcome = process_file(spark, config, path, scan)
        return outcome is not None and delete_source(config, outcome)

    return handle


def main(argv: list[str] | None = None, scan: Scan | None = None) -> int:
    """0: all well, 1: files failed, 2: the configuration or the state cannot be read."""
    p = argparse.ArgumentParser(prog="refrain-cutter")
    p.add_argument("--config", required=True)
    p.add_argument("--state", help="folder of the state table (the configuration's name and .state)")
    p.add_argument("--once", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("refrain-cutter").getOrCreate()
    if scan is None:
        from refrain.cli import file_report

        scan = lambda path, params: file_report(spark, path, params)
    try:
        text = "\n".join(r[0] for r in spark.read.text(args.config, wholetext=True).collect())
        configs = parse_config(text.removeprefix("﻿"))
        state = args.state or f"{args.config.removesuffix(split_name(args.config)[1])}.state"
        if args.once:
            failed = sum(run_once(spark, c, state, handler(spark, scan))[1] for c in configs if c.enable)
            return 1 if failed else 0
        run_daemon(spark, configs, state, handler(spark, scan))
    except KeyboardInterrupt:
        return 0
    except (ValueError, OSError, json.JSONDecodeError) as e:
        print(f"refrain-cutter: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # Spark's own errors on what cannot be read
        if type(e).__module__.startswith("pyspark"):
            print(f"refrain-cutter: {e}", file=sys.stderr)
            return 2
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
