import json
import os
import struct
import wave
from datetime import time as clock

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain import cli
from refrain.operators.buckets import tumbling
from refrain.operators.timestamps import raw_time, repaired
from refrain.options import AnalyzerOptions
from refrain.sources.media import counters, scan_audio, scan_video
from refrain.streaming import cutter
from refrain.streaming.watch import FolderConfig, due, parse_config, read_state, run_once

SIZE = 188 * 50


def report(programmes, duration=50.0):
    rows = [{"start_byte": a, "end_byte": b, "start_time_seconds": s, "end_time_seconds": e} for a, b, s, e in programmes]
    return {"programme_guesses": rows, "input": {"duration_seconds": duration}}


TWO = report([(0, 188 * 10 - 1, 0.0, 10.0), (188 * 20 + 5, 188 * 40 - 1, 20.0, 40.0)])


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "in" / "Show.ts"
    path.parent.mkdir()
    path.write_bytes(os.urandom(SIZE))
    os.utime(path, (1_700_000_000,) * 2)
    return path


def config(tmp_path, **more):
    return FolderConfig(**({"name": "n", "folder": str(tmp_path / "in"), "check_times": (clock(0),), "output_folder": str(tmp_path / "out")} | more))


def test_parts_reproduce_the_source_and_are_resumed(spark, source, tmp_path):
    content = source.read_bytes()
    got = cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: TWO)
    names = [x.rsplit("/", 1)[-1] for x in got.outputs]
    assert names == ["Show.part001_programme_00-00-00_00-00-10.ts", "Show.part002_between_00-00-10_00-00-20.ts", "Show.part003_programme_00-00-20_00-00-40.ts", "Show.part004_between_00-00-40_00-00-50.ts"]
    assert b"".join(open(x, "rb").read() for x in got.outputs) == content
    assert all(os.stat(x).st_mtime == 1_700_000_000 for x in got.outputs)
    kept = os.stat(got.outputs[0]).st_ino
    os.remove(got.outputs[2])
    again = cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: TWO)
    assert again == got and cutter.complete(got) and os.stat(got.outputs[0]).st_ino == kept
    assert sorted(os.listdir(tmp_path / "out")) == names  # no drafts are left


def test_other_parts_and_wrong_sizes_are_refused(spark, source, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "SHOW.part009_between_x.TS").write_bytes(b"x")
    with pytest.raises(ValueError, match="another cut"):
        cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: TWO)
    os.remove(out / "SHOW.part009_between_x.TS")
    (out / "Show.part001_programme_00-00-00_00-00-10.ts").write_bytes(b"x")
    with pytest.raises(ValueError, match="size"):
        cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: TWO)
    assert os.listdir(out) == ["Show.part001_programme_00-00-00_00-00-10.ts"]


def test_an_error_rolls_back_what_was_made(spark, source, tmp_path):
    done = cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: TWO)
    os.remove(done.outputs[1])

    def changed(path, params):
        return TWO

    first = cutter.snapshot(str(source))
    real, calls = cutter.snapshot, []

    def snapshot(path):
        calls.append(path)
        got = real(path)
        return cutter.Snapshot(path, got.size, got.modified_ns + 1) if path == first.path and calls.count(path) == 3 else got

    cutter.snapshot = snapshot
    try:
        with pytest.raises(OSError, match="changed"):
            cutter.process_file(spark, config(tmp_path), str(source), changed)
    finally:
        cutter.snapshot = real
    assert not os.path.exists(done.outputs[1]) and os.path.exists(done.outputs[0])


def test_files_that_are_young_short_or_changing_wait(spark, source, tmp_path):
    assert cutter.process_file(spark, config(tmp_path, mtime_over=1e12), str(source), lambda p, o: TWO) is None
    short = source.with_name("short.ts")
    short.write_bytes(b"x" * 187)
    assert cutter.process_file(spark, config(tmp_path), str(short), lambda p, o: TWO) is None

    def touch(path, params):
        os.utime(path, (1_700_000_001,) * 2)
        return TWO

    assert cutter.process_file(spark, config(tmp_path), str(source), touch) is None
    with pytest.raises(ValueError):
        cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: {"input": {}})
    with pytest.raises(ValueError):
        cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: report([], 8 * 86400.0))
    with pytest.raises(ValueError):
        cutter.process_file(spark, config(tmp_path), str(source), lambda p, o: report([(0, None, 0.0, 1.0)]))


def test_sources_go_only_when_their_parts_are_complete(spark, source, tmp_path):
    c = config(tmp_path, delete_source=True)
    done = cutter.process_file(spark, c, str(source), lambda p, o: TWO)
    os.rename(done.outputs[0], tmp_path / "away")
    with pytest.raises(OSError):
        cutter.delete_source(c, done)
    os.rename(tmp_path / "away", done.outputs[0])
    assert cutter.delete_source(config(tmp_path), done) and source.exists()
    assert cutter.delete_source(c, done) and not source.exists()


def test_the_watcher_cuts_once_and_counts_failures(spark, source, tmp_path):
    c, state, calls = config(tmp_path, folder=f"file://{tmp_path}/in"), f"file://{tmp_path}/state", []

    def scan(path, params):
        calls.append(path)
        return TWO

    assert run_once(spark, c, state, cutter.handler(spark, scan)) == (1, 0)
    assert run_once(spark, c, state, cutter.handler(spark, scan)) == (0, 0) and len(calls) == 1
    other = FolderConfig("other", c.folder, c.check_times, (), c.output_folder)
    assert run_once(spark, other, state, cutter.handler(spark, scan)) == (1, 0)  # another configuration's work
    again = FolderConfig("n", c.folder, c.check_times, ("--top-k", "3"), c.output_folder)
    assert run_once(spark, again, state, cutter.handler(spark, lambda p, o: {})) == (0, 1)
    assert due(spark.createDataFrame([], "path string, length long, modificationTime timestamp"), read_state(spark, state), c, __import__("datetime").datetime.now()).isEmpty()


def test_an_unreadable_state_is_an_error(spark, source, tmp_path):
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):
        run_once(spark, config(tmp_path, folder=f"file://{tmp_path}/in"), f"file://{tmp_path}/state", lambda p, c: None)


def test_cutter_command(spark, source, tmp_path):
    text = [{"name": "a", "folder": f"file://{tmp_path}/in", "output_folder": str(tmp_path / "out"), "check_time": "00:00", "params": "--top-k '3'"}]
    assert parse_config(json.dumps(text))[0].params == ("--top-k", "3")
    (tmp_path / "c.json").write_text(json.dumps(text))
    args = ["--config", f"file://{tmp_path}/c.json", "--state", f"file://{tmp_path}/state", "--once"]
    assert cutter.main(args, lambda p, o: TWO) == 0 and len(os.listdir(tmp_path / "out")) == 4
    (source.parent / "bad.ts").write_bytes(b"x" * 400)
    assert cutter.main(args, lambda p, o: {}) == 1
    (tmp_path / "c.json").write_text("{}")
    assert cutter.main(args, lambda p, o: TWO) == 2
    assert cutter.main(["--config", f"file://{tmp_path}/none.json", "--once"], lambda p, o: TWO) == 2


def wav(path, seconds, seed):
    x = np.random.default_rng(seed).integers(-9000, 9000, int(8000 * seconds)).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(x.tobytes())


def y4m(pictures, rate="2:1", size=(8, 6)):
    w, h = size
    head = f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C420jpeg\n".encode()
    return head + b"".join(b"FRAME\n" + p.astype(np.uint8).tobytes() + bytes(2 * (w // 2) * (h // 2)) for p in pictures)


def test_video_frames_and_broken_ones(spark, tmp_path):
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 255, (6, 8)) for _ in range(6)]
    content = y4m(pictures)
    frame = (len(content) - content.index(b"FRAME")) // 6
    at = content.index(b"FRAME") + 2 * frame
    (tmp_path / "a.y4m").write_bytes(content[:at] + b"GARBLE" + content[at + 6 :] + b"FRAME\nshort")
    (tmp_path / "b.y4m").write_bytes(b"nothing")
    rows = scan_video(spark, f"file://{tmp_path}").collect()
    own = sorted((r for r in rows if r["source_path"].endswith("a.y4m")), key=lambda r: r["seq"])
    assert [r["is_corrupt"] for r in own] == [False, False, True, False, False, False, True]
    assert all(len(r["gray"]) == 576 for r in own if not r["is_corrupt"])
    assert abs(np.frombuffer(own[0]["gray"], np.uint8).mean() - pictures[0].mean()) < 1
    assert [r["error"] for r in rows if r["source_path"].endswith("b.y4m")] == ["ValueError: not a YUV4MPEG2 stream"]
    assert sorted(r["decode_errors"] for r in counters(scan_video(spark, f"file://{tmp_path}")).collect()) == [1, 2]


def test_corrupt_sound_has_a_reason(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    row = scan_audio(spark, f"file://{tmp_path}").first()
    assert row["is_corrupt"] and row["error"]


def test_scan_command_with_sound_video_limit_and_errors(spark, tmp_path, capsys):
    folder = tmp_path / "m"
    folder.mkdir()
    for i in range(3):
        wav(folder / f"{i}.wav", 4, i)
    rng = np.random.default_rng(1)
    (folder / "v.y4m").write_bytes(y4m([rng.integers(0, 255, (36, 64)) for _ in range(12)], size=(64, 36)) + b"FRAME\nx")
    db, out = f"file://{tmp_path}/db", tmp_path / "out.json"
    args = ["scan", "--input", f"file://{folder}", "--db", db, "--store", "--max-recordings", "2", "--output", str(out), "--no-programme-inference"]
    assert cli.main(args) == 0
    text = out.read_text()
    docs, decoder = [], json.JSONDecoder()
    while text.strip():
        doc, end = decoder.raw_decode(text.lstrip())
        docs.append(doc)
        text = text.lstrip()[end:]
    assert len(docs) == 4 and [d["input"]["recoverable_decode_errors"] for d in docs] == [0, 0, 0, 1]
    assert docs[3]["input"]["duration_seconds"] == 6.0 and all(d["stored"] for d in docs)
    assert cli.main(["info", "--db", db]) == 0
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["maximum_recordings"] == 2 and info["recordings"] == 2
    assert cli.main(["scan", "--input", f"file://{folder}", "--mode", "video", "--output", str(out), "--no-timestamp-repair"]) == 0
    assert json.loads(out.read_text())["input"]["path"].endswith("v.y4m")


def test_repair_can_be_switched_off(spark):
    rows = [("s", "video", i, t, 1.0) for i, t in enumerate([0.0, 1.0, 100.0, 101.0])]
    frames = spark.createDataFrame(rows, "source_id string, stream string, seq long, raw_s double, frame_s double")
    on = [r["out_s"] for r in repaired(frames).orderBy("seq").collect()]
    off = [r["out_s"] for r in repaired(frames, AnalyzerOptions(repair_timestamp_discontinuities=False)).orderBy("seq").collect()]
    assert on == [0, 1, 2, 3] and off == [0, 1, 100, 101]


def test_a_broken_clock_asks_for_no_buckets(spark):
    rows = spark.createDataFrame([("s", 1.0), ("s", 1e12)], "k string, t double")
    with pytest.raises(Exception, match="longer than"):
        tumbling(rows, ["k"], F.col("t"), 1.0, {"n": F.count("*")}, 7 * 86400.0).collect()


def test_raw_times(spark):
    rows = spark.createDataFrame([(9000, 1 / 90000, 0.05), (None, 1 / 90000, 0.0), (90000, 1 / 90000, None), (5, 0.0, 0.0)], "pts long, base double, origin double")
    got = [r[0] for r in rows.select(raw_time(F.col("pts"), F.col("base"), F.col("origin"))).collect()]
    assert got[1] is None and got[3] is None and abs(got[0] - 0.05) < 1e-12 and abs(got[2] - 1) < 1e-12


@pytest.mark.parametrize("flag,value,ok", [("--threshold", "0.9", True), ("--threshold", "nan", False), ("--threshold", " 0.9", False), ("--top-k", "1_0", False), ("--top-k", "7", True), ("--top-k", "7.5", False), ("--audio-hop", "inf", False), ("--max-gap", "1e400", False)])
def test_numbers_are_parsed_strictly(flag, value, ok):
    args = ["scan", "--input", "x", flag, value]
    if ok:
        assert cli.parser().parse_args(args)
    else:
        with pytest.raises(SystemExit):
            cli.parser().parse_args(args)
