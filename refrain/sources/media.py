"""Decoded media: WAV sound and Y4M pictures, which need no codec; anything else by a decoder of one's own.

A decoder maps a file's bytes to a stream of timed pieces. Decoding errors do not end a scan: a file that cannot be
read is one row with the reason, and frames that cannot be read are counted.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.features import HEIGHT, WIDTH
from refrain.options import AnalyzerOptions

RATE = 8000
SAMPLES = "source_id string, source_path string, size long, duration double, bucket long, samples array<float>, start_byte long, end_byte long, is_corrupt boolean, error string"
FRAMES = "source_id string, source_path string, size long, seq long, raw_s double, frame_s double, gray binary, start_byte long, end_byte long, is_corrupt boolean, error string"


class Decoder(Protocol):
    """Maps a file's bytes to mono samples at RATE and the bytes that hold them (first, last)."""

    def __call__(self, content: bytes) -> tuple[np.ndarray, int, int]: ...


def decode_wav(content: bytes) -> tuple[np.ndarray, int, int]:
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width not in (1, 2, 4):
        raise ValueError("8, 16 or 32 bit samples")
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    mono = x.reshape(-1, channels).mean(axis=1)
    n = int(round(len(mono) * RATE / rate))
    out = np.interp(np.arange(n) * rate / RATE, np.arange(len(mono)), mono) if n else mono[:0]
    first = len(content) - len(raw)
    return out.astype(np.float32), first, len(content) - 1


def scan_audio(spark: SparkSession, path: str, options: AnalyzerOptions | None = None, decoder: Decoder = decode_wav, glob: str = "*.wav") -> DataFrame:
    """One row per file and bucket with its samples; undecodable files are one row that is_corrupt."""
    o = options or AnalyzerOptions()
    if o.mode == "video":
        raise ValueError("audio files hold no video stream")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per = int(round(o.bucket_seconds * RATE))
        for batch in batches:
            for at, content, size in zip(batch["path"], batch["content"], batch["length"], strict=True):
                try:
                    x, first, last = decoder(content)
                except (ValueError, EOFError, wave.Error) as e:
                    yield pd.DataFrame([(at, at, size, 0.0, 0, [], -1, -1, True, f"{type(e).__name__}: {e}")], columns=[c.split()[0] for c in SAMPLES.split(", ")])
                    continue
                rows = []
                for k in range(max(1, -(-len(x) // per))):
                    own = x[k * per : (k + 1) * per]
                    share = (last - first + 1) / max(1, len(x))
                    rows.append((at, at, size, len(x) / RATE, k, own.tolist(), first + int(k * per * share), first + int((k * per + len(own)) * share) - 1, False, None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", "length").mapInPandas(run, SAMPLES)


def scaled(plane: np.ndarray, height: int = HEIGHT, width: int = WIDTH) -> np.ndarray:
    """A grey plane as the means of height x width areas; larger pictures are averaged, smaller ones repeated."""
    rows = np.arange(height + 1) * plane.shape[0] / height
    cols = np.arange(width + 1) * plane.shape[1] / width

    def weights(edges: np.ndarray, n: int) -> np.ndarray:
        low, high = edges[:-1, None], edges[1:, None]
        cell = np.arange(n)[None]
        return np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None) / (high - low)

    return weights(rows, plane.shape[0]) @ plane.astype(np.float64) @ weights(cols, plane.shape[1]).T


#: Bytes of a frame's colour planes as a share of its luma plane, by the header's colour space.
CHROMA = {"mono": 0.0, "420": 0.5, "411": 0.5, "422": 1.0, "444": 2.0}


def decode_y4m(content: bytes) -> Iterator[tuple[int, float | None, float, bytes | None, int, int]]:
    """(number, time, length, grey 18 x 32 picture or None if broken, first byte, last byte) of each frame."""
    head, _, _ = content.partition(b"\n")
    fields = head.decode("ascii", "replace").split(" ")
    if fields[0] != "YUV4MPEG2":
        raise ValueError("not a YUV4MPEG2 stream")
    known = {f[:1]: f[1:] for f in fields[1:] if f}
    width, height = int(known["W"]), int(known["H"])
    over, _, under = known.get("F", "25:1").partition(":")
    if width <= 0 or height <= 0 or int(over) <= 0 or int(under) <= 0:
        raise ValueError("a picture's size and rate must be positive")
    space = known.get("C", "420")
    share = next((v for k, v in CHROMA.items() if space.startswith(k)), None)
    if share is None or "p1" in space:
        raise ValueError(f"colour space {space}")
    luma = width * height
    chroma = 2 * (-(-width // 2) * -(-height // 2)) if space.startswith("420") else int(luma * share)
    at, n, length = len(head) + 1, 0, int(under) / int(over)
    while at < len(content):
        line = content.find(b"\n", at, at + 256)
        if line < 0 or not content.startswith(b"FRAME", at):
            # A broken frame: go on with the next marker.
            again = content.find(b"FRAME", at + 1)
            end = len(content) if again < 0 else again
            yield n, None, length, None, at, end - 1
            at, n = end, n + 1
            continue
        end = line + 1 + luma + chroma
        plane = np.frombuffer(content, np.uint8, luma, line + 1).reshape(height, width) if end <= len(content) else None
        gray = None if plane is None else np.clip(np.rint(scaled(plane)), 0, 255).astype(np.uint8).tobytes()
        yield n, n * length, length, gray, at, min(end, len(content)) - 1
        at, n = end, n + 1


def scan_video(spark: SparkSession, path: str, options: AnalyzerOptions | None = None, decoder=decode_y4m, glob: str = "*.y4m") -> DataFrame:
    """One row per file and frame with its grey picture; undecodable files and broken frames are corrupt."""
    o = options or AnalyzerOptions()
    if o.mode == "audio":
        raise ValueError("video files hold no audio stream")
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content, size in zip(batch["path"], batch["content"], batch["length"], strict=True):
                rows = []
                try:
                    for n, raw, length, gray, first, last in decoder(content):
                        rows.append((at, at, size, n, raw, length, gray, first, last, gray is None, None if gray is not None else "broken frame"))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (ValueError, KeyError, EOFError) as e:
                    rows.append((at, at, size, -1, None, 0.0, None, -1, -1, True, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", "length").mapInPandas(run, FRAMES)


def counters(scanned: DataFrame) -> DataFrame:
    """source_id, decode_errors: files and frames that could not be read."""
    return scanned.groupBy("source_id").agg(F.count_if("is_corrupt").alias("decode_errors"))


def folder_files(spark: SparkSession, folder: str, glob: str = "*.[tT][sS]") -> DataFrame:
    """Path, length and time of a folder's files, in the order of their lower-cased names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")
    return files.orderBy(F.lower(F.element_at(F.split("path", "/"), -1)))
