"""The timestamp repair as a stateful stream: one state per source, no watermark, nothing dropped."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from refrain.operators.timestamps import SCHEMA, Clock
from refrain.options import AnalyzerOptions


def repaired_stream(frames: DataFrame, options: AnalyzerOptions | None = None) -> DataFrame:
    """As operators.timestamps.repaired, over a stream; frames of a batch are taken by seq."""
    o = options or AnalyzerOptions()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = Clock(o.timestamp_jump_threshold_seconds, o.timestamp_backwards_tolerance_seconds, o.repair_timestamp_discontinuities)
        if state.exists:
            clock.frontier, streams = state.get
            clock.streams = json.loads(streams)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        got = [clock.advance(s, None if pd.isna(r) else r, n) for s, r, n in zip(rows["stream"], rows["raw_s"], rows["frame_s"], strict=True)]
        state.update((clock.frontier, json.dumps(clock.streams)))
        out, event, previous = zip(*got, strict=True)
        yield rows[["source_id", "stream", "seq", "raw_s"]].assign(out_s=out, event=event, previous_raw_s=pd.Series(previous, rows.index, dtype="float64"))

    return frames.groupBy("source_id").applyInPandasWithState(run, SCHEMA, "frontier double, streams string", "append", GroupStateTimeout.NoTimeout)
