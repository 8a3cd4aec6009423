"""Repair of jumping media clocks, in decode order, with one frontier for all of a source's streams."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.options import AnalyzerOptions

SCHEMA = "source_id string, stream string, seq long, raw_s double, out_s double, event string, previous_raw_s double"


def raw_time(pts: Column, time_base: Column, origin: Column) -> Column:
    """A frame's time in seconds from the stream's origin, for ``repaired``; null without a timestamp or a positive time base."""
    return F.when(time_base > 0, pts.cast("double") * time_base - F.coalesce(origin, F.lit(0.0)))


@dataclass
class Clock:
    """State of one source: per stream offset, last raw and output times and the next expected one."""

    forward: float
    backward: float
    repair: bool = True
    frontier: float = 0.0
    streams: dict[str, list] = field(default_factory=dict)

    def advance(self, stream: str, raw: float | None, length: float) -> tuple[float, str | None, float | None]:
        """The frame's time, and how its clock jumped and from where, if it did."""
        length = max(1e-6, length)
        state = self.streams.get(stream)
        event = previous = None
        if raw is None or not math.isfinite(raw):
            out = state[3] if state else self.frontier
            if state:
                state[2], state[3] = out, out + length
            else:
                self.streams[stream] = [0.0, 0.0, out, out + length]
        else:
            if state is None:
                offset, out = 0.0, max(0.0, raw)
                if self.repair and out > self.frontier + self.forward:
                    offset, out, event, previous = self.frontier - raw, self.frontier, "forward", raw
            else:
                offset, previous_raw, last, expected = state
                out = raw + offset
                if not self.repair:
                    out = max(0.0, out)
                elif out > max(expected, self.frontier) + self.forward:
                    event = "forward"
                elif out < expected - self.backward:
                    event = "backward"
                else:
                    out = max(out, last)
                if event:
                    out, previous = expected, previous_raw
                    offset = out - raw
            self.streams[stream] = [offset, raw, out, out + length]
        self.frontier = max(self.frontier, out + length)
        return out, event, previous


def repaired(frames: DataFrame, options: AnalyzerOptions | None = None) -> DataFrame:
    """frames(source_id, stream, seq, raw_s, frame_s) with out_s and the jumps, a source at a time.

    Frames are re-timed in the order of seq, never dropped; the state depends on every frame before,
    so that a source is one group.
    """
    o = options or AnalyzerOptions()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        clock = Clock(o.timestamp_jump_threshold_seconds, o.timestamp_backwards_tolerance_seconds, o.repair_timestamp_discontinuities)
        rows = rows.sort_values("seq", kind="stable")
        got = [clock.advance(s, None if pd.isna(r) else r, n) for s, r, n in zip(rows["stream"], rows["raw_s"], rows["frame_s"], strict=True)]
        out, event, previous = zip(*got, strict=True)
        return rows[["source_id", "stream", "seq", "raw_s"]].assign(out_s=out, event=event, previous_raw_s=pd.Series(previous, rows.index, dtype="float64"))

    return frames.groupBy("source_id").applyInPandas(run, SCHEMA)
