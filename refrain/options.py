"""Settings, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Kinds by rank, content types, and types that name known content.
KINDS = ("video_perceptual", "audio_spectrum")
CONTENT_TYPES = ("advertisement", "programme", "break_out", "break_in", "recording", "unknown")
KNOWN_TYPES = ("advertisement", "programme", "break_out", "break_in")
VIDEO_SPACE, AUDIO_SPACE = "perceptual-video-v2:d128", "spectrum-audio-v2:d128"
EXACT_LIMIT = 20_000


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _share(x: float) -> bool:
    return math.isfinite(x) and 0 <= x <= 1


@dataclass(frozen=True)
class SearchOptions:
    minimum_similarity: float = 0.985
    top_k: int = 12
    find_internal_duplicates: bool = True
    minimum_duration_seconds: float = 5.0
    offset_bin_seconds: float = 1.0
    maximum_anchor_gap_seconds: float = 2.5
    minimum_anchors: int = 3
    #: exact, hashed, or auto: hashed beyond EXACT_LIMIT stored vectors
    method: str = "auto"

    def __post_init__(self) -> None:
        _need(self.method in ("auto", "exact", "hashed"), "the method is auto, exact or hashed")
        _need(-1 <= self.minimum_similarity <= 1, "the similarity must lie in -1..1")
        _need(self.top_k > 0, "top_k must be positive")
        _need(min(self.minimum_duration_seconds, self.offset_bin_seconds, self.maximum_anchor_gap_seconds) > 0, "alignment durations must be positive")

    @property
    def self_k(self) -> int:
        return max(64, self.top_k + 16)


@dataclass(frozen=True)
class InferenceOptions:
    minimum_programme_seconds: float = 120.0
    maximum_short_repeat_seconds: float = 180.0
    ad_block_gap_seconds: float = 20.0
    minimum_ad_break_seconds: float = 10.0
    minimum_ad_occurrences: int = 2
    minimum_ad_families: int = 2
    feature_alignment_tolerance_seconds: float = 3.0
    minimum_audio_similarity: float = 0.985
    minimum_video_similarity: float = 0.985
    audio_video_confirmation_margin: float = 0.02
    maximum_marker_seconds: float = 30.0
    minimum_marker_occurrences: int = 3

    def __post_init__(self) -> None:
        _need(self.minimum_programme_seconds > 0 and self.maximum_short_repeat_seconds > 0, "durations must be positive")
        _need(self.ad_block_gap_seconds >= 0 and self.feature_alignment_tolerance_seconds >= 0, "gaps must not be negative")
        _need(math.isfinite(self.minimum_ad_break_seconds) and self.minimum_ad_break_seconds >= 0, "the shortest break must be finite")
        _need(self.minimum_ad_occurrences >= 2 and self.minimum_ad_families >= 1, "too few advertisements asked for")
        _need(all(map(_share, (self.minimum_audio_similarity, self.minimum_video_similarity, self.audio_video_confirmation_margin))), "similarities lie in 0..1")
        _need(math.isfinite(self.maximum_marker_seconds) and self.maximum_marker_seconds > 0, "markers must have a length")
        _need(self.minimum_marker_occurrences >= 2, "a marker occurs twice at least")

    @property
    def longest_block(self) -> float:
        return max(360.0, 2 * self.maximum_short_repeat_seconds)


@dataclass(frozen=True)
class AnalyzerOptions:
    mode: str = "auto"
    bucket_seconds: float = 1.0
    audio_hop_seconds: float = 0.5
    repair_timestamp_discontinuities: bool = True
    timestamp_jump_threshold_seconds: float = 10.0
    timestamp_backwards_tolerance_seconds: float = 1.0

    def __post_init__(self) -> None:
        _need(self.mode in ("auto", "video", "audio", "both"), "mode is auto, video, audio or both")
        _need(self.bucket_seconds > 0, "buckets must have a length")
        _need(0 < self.audio_hop_seconds <= self.bucket_seconds, "the hop lies in a bucket")
        _need(self.timestamp_jump_threshold_seconds > 0 and self.timestamp_backwards_tolerance_seconds >= 0, "thresholds of the timestamp repair")
