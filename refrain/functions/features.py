"""Video and audio features of 128 numbers, vectorised in numpy, and the extractor protocol."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEIGHT, WIDTH = 18, 32
RATE, FFT, BANDS = 8000, 512, 24


class Extractor(Protocol):
    """A vector space and the way into it; ``column`` maps a column of raw data to vectors."""

    extractor_id: str
    kind: str
    dim: int

    def column(self, raw: Column) -> Column: ...


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v.astype(np.float64) ** 2).sum())
    return v if n * n <= 1e-20 else (v * np.float32(1 / n)).astype(np.float32)


@lru_cache(1)
def _cosines() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(8)[:, None]
    basis = lambda n: np.cos(np.pi * (2 * np.arange(n)[None] + 1) * k / (2 * n))
    return basis(HEIGHT), basis(WIDTH)


def video_feature(gray: bytes) -> np.ndarray:
    """Of an 18 x 32 grey frame: transform, cells, histogram and edge directions."""
    px = np.frombuffer(gray, np.uint8).reshape(HEIGHT, WIDTH).astype(np.float64)
    mean = px.mean()
    rows, cols = _cosines()
    out = np.zeros(128)
    out[:64] = (rows @ (px - mean) @ cols.T).ravel() / (255 * px.size)
    out[0] = mean / 255
    edges = [c * HEIGHT // 4 for c in range(5)]
    for c in range(4):
        cells = px[edges[c] : edges[c + 1]].reshape(-1, 8, WIDTH // 8)
        out[64 + 8 * c : 72 + 8 * c] = (cells.mean(axis=(0, 2)) - mean) / 255
    out[96:112] = np.bincount(px.astype(np.int64).ravel() >> 4, minlength=16) / px.size
    gx, gy = px[1:-1, 2:] - px[1:-1, :-2], px[2:, 1:-1] - px[:-2, 1:-1]
    ax, ay = np.abs(gx), np.abs(gy)
    way = np.select([ax > 2 * ay, ay > 2 * ax, gx * gy >= 0], [0, 1, 2], 3)
    y, x = np.mgrid[1 : HEIGHT - 1, 1 : WIDTH - 1]
    quadrant = 2 * (y >= HEIGHT // 2) + (x >= WIDTH // 2)
    size = np.hypot(gx, gy)
    if size.sum() > 0:
        out[112:] = np.bincount((4 * quadrant + way).ravel(), size.ravel(), 16) / size.sum()
    return unit(out.astype(np.float32))


@lru_cache(1)
def _bands() -> np.ndarray:
    """[bins, BANDS] membership of the transform's bins in logarithmic bands from 60 to 3800 Hz."""
    hz = np.arange(FFT // 2) * RATE / FFT
    out = np.zeros((FFT // 2, BANDS))
    for b in np.flatnonzero((hz >= 60) & (hz <= 3800)):
        out[b, min(BANDS - 1, int(np.log(hz[b] / 60) / np.log(3800 / 60) * BANDS))] = 1
    out[0] = 0
    return out


def audio_feature(samples: np.ndarray) -> np.ndarray:
    """Of mono samples at 8 kHz: band statistics, their course over quarters, loudness and shape."""
    n = len(samples)
    if not n:
        return np.zeros(128, np.float32)
    x = np.asarray(samples, np.float64)
    hop = FFT // 2
    starts = np.arange(0, max(1, n - FFT + hop), hop)
    padded = np.pad(x, (0, max(0, int(starts[-1]) + FFT - n)))
    frames = padded[starts[:, None] + np.arange(FFT)] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / (FFT - 1)))
    power = (np.abs(np.fft.fft(frames)[:, :hop]) ** 2) @ _bands()
    level = np.log1p(power)
    mean, raw = level.mean(axis=0), power.mean(axis=0)
    out = np.zeros(128)
    out[:24] = mean
    out[24:48] = np.sqrt(np.maximum(0, (level**2).mean(axis=0) - mean**2))
    out[48:72] = np.abs(np.diff(level, axis=0)).sum(axis=0) / max(1, len(starts) - 1)
    quarter = np.minimum(3, (starts + hop) * 4 // n)
    for q in range(4):
        own = level[quarter == q]
        out[72 + 12 * q : 84 + 12 * q] = own.reshape(-1, 12, 2).sum(axis=(0, 2)) / max(1, len(own))
    rms, peak, total = np.sqrt((x * x).mean()), np.abs(x).max(), raw.sum()
    negative = np.asarray(samples) < 0
    out[120:127] = (
        rms,
        (negative[1:] != negative[:-1]).sum() / n,
        raw @ np.arange(BANDS) / (23 * total) if total > 0 else 0,
        np.exp(np.log(raw + 1e-12).mean()) / raw.mean() if total > 0 else 0,
        np.abs(x).mean(),
        peak,
        rms / peak if peak > 0 else 0,
    )
    out[127] = np.log((raw[:4].sum() + 1e-12) / (raw[20:].sum() + 1e-12))
    return unit(out.astype(np.float32))


@dataclass(frozen=True)
class VideoExtractor:
    extractor_id: str = "perceptual-video-v2:d128"
    kind: str = "video_perceptual"
    dim: int = 128

    def column(self, raw: Column) -> Column:
        """raw: binary of 576 grey pixels."""

        @F.pandas_udf("array<float>")
        def run(frames: pd.Series) -> pd.Series:
            return frames.map(lambda f: None if f is None else video_feature(f))

        return run(raw)


@dataclass(frozen=True)
class AudioExtractor:
    extractor_id: str = "spectrum-audio-v2:d128"
    kind: str = "audio_spectrum"
    dim: int = 128

    def column(self, raw: Column) -> Column:
        """raw: array of samples at 8 kHz."""

        @F.pandas_udf("array<float>")
        def run(parts: pd.Series) -> pd.Series:
            return parts.map(lambda s: None if s is None else audio_feature(np.asarray(s, np.float32)))

        return run(raw)
