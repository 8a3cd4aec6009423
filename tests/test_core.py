import json
import math
import wave
from datetime import datetime, time

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions.features import audio_feature, video_feature
from refrain.functions.lsh import mixed, signatures
from refrain.functions.naming import clock_text, fnv1a, part_name
from refrain.operators.partition import packet_ranges
from refrain.operators.search import base_vectors, exact_top_k, lsh_top_k, stored
from refrain.operators.timestamps import Clock
from refrain.options import SearchOptions
from refrain.plans.report import dumps, scan_report
from refrain.plans.scan import duplicates
from refrain.sources.catalog import Catalog
from refrain.streaming.watch import FolderConfig, latest_trigger, parse_config, parse_times


def synthetic(spark, windows=False):
    s = F.col("id")
    two = lambda a, b: F.array(a.cast("float"), b.cast("float"))
    media = spark.createDataFrame([("source-a", "", "synthetic.ts", "advertisement", 20.0)], "source_id string, source_name string, source_path string, source_type string, duration double")
    buckets = spark.range(20).select(
        F.lit("source-a").alias("source_id"), s.cast("double").alias("start_s"), (s + 1).cast("double").alias("end_s"), (s * 1000).alias("start_byte"), (s * 1000 + 999).alias("end_byte"),
        two(s % 10 + 1, s * 3 % 10 + 1).alias("video"), two(s % 10 + 2, s * 7 % 10 + 1).alias("audio"),
    )
    extra = spark.createDataFrame([("source-a", 0.0, 1.0, 0, 999, [1.0, 2.0]), ("source-a", 0.5, 1.5, 500, 1499, [1.0, 2.0])], "source_id string, start_s double, end_s double, start_byte long, end_byte long, values array<float>")
    return base_vectors(media, buckets, extra if windows else None)


def test_base_vectors_and_alignment(spark):
    v = synthetic(spark)
    assert v.count() == 40 and synthetic(spark, True).count() == 22
    spans = duplicates(v, None, SearchOptions(minimum_similarity=0.999, top_k=32)).collect()
    assert any(r["q_start"] == 0 and r["r_start"] == 10 and r["q_end"] >= 10 and r["anchor_count"] >= 10 for r in spans)


def test_catalogue_round_trip_and_retention(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.create(2)
    with pytest.raises(FileExistsError):
        c.create()
    v = synthetic(spark)
    c.replace_sources(v, ["source-a"])
    assert c.info() == {"schema_version": 4, "vectors": 40, "sources": 1, "recordings": 0, "extractors": 2, "maximum_recordings": 2}
    top = exact_top_k(v, c.vectors(), 1, 0.9).collect()
    assert all(r["similarity"] > 0.99 and r["ref_source_type"] == "advertisement" for r in top)
    rec = lambda i: v.withColumns({"source_id": F.lit(i), "source_type": F.lit("recording")})
    gone = lambda i: [r[0] for r in c.replace_sources(rec(i), [i]).collect()]
    assert [gone(i) for i in ("rec-1", "rec-2", "rec-3")] == [[], [], ["rec-1"]]
    assert gone("rec-2") == []
    assert gone("rec-4") == ["rec-3"]
    assert Catalog(spark, c.root).info()["recordings"] == 2
    with pytest.raises(ValueError):
        c.replace_sources(v.withColumn("values", F.array(F.lit(1.0).cast("float"))), ["source-a", "x"])
    with pytest.raises(ValueError):
        c.configure(-1)


def test_hashed_search_finds_one_of_many(spark):
    i = np.arange(21_000, dtype=np.uint64)[:, None]
    d = np.arange(16, dtype=np.uint64)[None]
    m = np.uint64(0xFFFFFFFF)
    b = ((i + np.uint64(1)) * np.uint64(2654435761)) & m
    b = b ^ (((d + np.uint64(11)) * np.uint64(2246822519)) & m)
    b = b ^ (b >> np.uint64(13))
    values = (b % np.uint64(2001)).astype(np.int64) - 1000
    rows = [("large", "", "", "unknown", "test-large:d16", "video_perceptual", float(k), k + 1.0, -1, -1, list(map(float, values[k]))) for k in range(12_000, 14_000)]
    schema = "source_id string, source_name string, source_path string, source_type string, extractor_id string, kind string, start_s double, end_s double, start_byte long, end_byte long, values array<float>"
    df = spark.createDataFrame(rows, schema)
    hits = lsh_top_k(df.filter("start_s = 12345"), stored(df), 5, 0.999).collect()
    assert 12345.0 in [h["ref_start_s"] for h in hits]
    assert mixed(0) == 0 and signatures(np.zeros((1, 16)))[0, 0] == (1 << 20) - 1


def test_timestamps():
    c = Clock(10, 1)
    got = [c.advance("video", float(r), 1.0) for r in (0, 1, 100, 101, 10)]
    assert [g[0] for g in got] == [0, 1, 2, 3, 4]
    assert [g[1] for g in got] == [None, None, "forward", None, "backward"]
    c = Clock(10, 1)
    c.advance("audio", 0.0, 1.0)
    c.frontier = 30.0
    assert c.advance("audio", 30.0, 1.0)[:2] == (30.0, None)
    assert Clock(10, 1).advance("a", float("nan"), 1.0)[0] == 0


@pytest.mark.parametrize(
    "segments,size,duration,expected",
    [
        ([(200, 400, 10, 20), (800, 1100, 40, 60)], 1880, 100, [(0, 188, 0, 10, "between"), (188, 564, 10, 20, "programme"), (564, 752, 20, 40, "between"), (752, 1128, 40, 60, "programme"), (1128, 1880, 60, 100, "between")]),
        ([], 1128, 6, [(0, 1128, 0, 6, "between")]),
        ([(188, 376, 0, 1), (400, 600, 2, 3)], 940, 5, [(0, 188, 0, 0, "between"), (188, 376, 0, 1, "programme"), (376, 752, 2, 3, "programme"), (752, 940, 3, 5, "between")]),
    ],
)
def test_packet_ranges(spark, segments, size, duration, expected):
    rows = spark.createDataFrame([("a", *s[:2], float(s[2]), float(s[3])) for s in segments], "source_id string, start_byte long, end_byte long, start_s double, end_s double")
    source = spark.createDataFrame([("a", size, float(duration))], "source_id string, size long, duration double")
    got = packet_ranges(rows, source).orderBy("part").collect()
    assert [(r["start"], r["end"], r["t0"], r["t1"], r["kind"]) for r in got] == expected


def test_names(spark):
    one = spark.range(1).select(part_name(F.lit("recording"), F.lit(3), F.lit("between"), F.lit(1.2), F.lit(4.1)).alias("n"), clock_text(F.lit(3725.9)).alias("c")).first()
    assert one["n"] == "recording.part003_between_00-00-01_00-00-05.ts" and one["c"] == "01:02:05"
    assert fnv1a("") == "cbf29ce484222325" and fnv1a("a") == "af63dc4c8601ec8c"


def test_report_escapes(spark):
    empty = duplicates(synthetic(spark), None, SearchOptions(minimum_similarity=1.0, minimum_duration_seconds=500.0))
    text = dumps(scan_report({"source_id": "s", "source_type": "unknown", "source_path": 'a"\\\n\x01', "duration": 1.0}, empty, 0))
    back = json.loads(text)
    assert back["schema_version"] == 3 and back["input"]["path"] == 'a"\\\n\x01' and back["input"]["dropped_packets"] == 0 and back["matches"] == []


def test_features():
    rng = np.random.default_rng(0)
    frame = rng.integers(0, 256, 576).astype(np.uint8)
    assert math.isclose(float((video_feature(frame.tobytes()).astype(float) ** 2).sum()), 1, abs_tol=1e-5)
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000).astype(np.float32)
    a, b = audio_feature(tone), audio_feature(np.sin(2 * np.pi * 3000 * np.arange(8000) / 8000).astype(np.float32))
    assert math.isclose(float((a.astype(float) ** 2).sum()), 1, abs_tol=1e-5) and float(a @ b) < 0.999
    assert not audio_feature(np.zeros(0)).any()


def test_wav_scan_through_the_command_line(spark, tmp_path, capsys):
    from refrain.cli import main

    rng = np.random.default_rng(5)
    tones = lambda n: np.concatenate([np.sin(2 * np.pi * f * np.arange(8000) / 8000) * a for f, a in zip(rng.uniform(80, 3500, n), rng.uniform(2000, 20000, n), strict=True)]).astype("<i2")
    part = tones(8)
    for name, x in (("a.wav", np.concatenate([part, tones(4), part])), ("broken.wav", None)):
        if x is None:
            (tmp_path / name).write_bytes(b"RIFF....")
            continue
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(x.tobytes())
    assert main(["scan", "--input", str(tmp_path), "--threshold", "0.99"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert any(abs(m["query"]["start_time_seconds"]) < 1 and abs(m["reference"]["start_time_seconds"] - 12) < 1 for m in report["matches"])
    assert report["timeline"]


def test_watch_settings():
    assert parse_times("10:30, 9:05") == (time(9, 5), time(10, 30))
    assert latest_trigger(parse_times("10:30,09:05"), datetime(2024, 1, 1, 10, 0)) == datetime(2024, 1, 1, 9, 5)
    assert latest_trigger(parse_times("10:30"), datetime(2024, 1, 1, 10, 0)) is None
    assert parse_config('[{"name": "n", "folder": "f", "check_time": "01:00"}]')[0].enable
    for bad in ({"delete_source": True}, {"mtime_over": -1.0}, {"params": ("--input",)}):
        with pytest.raises(ValueError):
            FolderConfig("n", "f", (), **bad)


def test_watcher_handles_each_file_once(spark, tmp_path):
    from refrain.streaming.watch import run_once

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.TS").write_bytes(b"x" * 400)
    (tmp_path / "in" / "short.ts").write_bytes(b"x")
    config, seen = FolderConfig("n", f"file://{tmp_path}/in", ()), []
    handle = lambda path, c: seen.append(path)
    later = datetime(2100, 1, 1)
    assert run_once(spark, config, f"file://{tmp_path}/state", handle, later) == (1, 0)
    assert run_once(spark, config, f"file://{tmp_path}/state", handle, later) == (0, 0)
    assert len(seen) == 1
