"""The scan report and the catalogue's description, as JSON."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.operators.align import in_order
from refrain.operators.timeline import Inference


def number(x: float | None) -> float | None:
    """Three decimals; null for what is not finite."""
    return None if x is None or not math.isfinite(x) else round(float(x), 3)


def byte(x: int | None) -> int | None:
    return None if x is None or x < 0 else int(x)


def _place(row, start: str, end: str, first: str, last: str) -> dict:
    return {"start_byte": byte(row[first]), "end_byte": byte(row[last]), "start_time_seconds": number(row[start]), "end_time_seconds": number(row[end])}


def _segment(r) -> dict:
    evidence = {
        "preceded_by_break": r["preceded"], "followed_by_break": r["followed"], "repeated_content_coverage": number(r["repeat_coverage"]),
        "audio_video_coverage": number(r["audio_video_coverage"]), "repeat_family_count": r["family_count"], "break_out_family_id": r["out_id"] or "", "break_in_family_id": r["in_id"] or "",
    }
    return {"label": r["label"], **_place(r, "start_s", "end_s", "start_byte", "end_byte"), "confidence": number(r["confidence"]), "boundary_uncertainty_seconds": number(r["uncertainty"]), "evidence": evidence}


def scan_report(media: dict, matches: DataFrame, vectors: int, inference: Inference | None = None, vectors_after: int | None = None) -> dict:
    """The report of one recording; its matches, families and segments are what reaches the driver."""
    jumps = [
        {"stream": e["stream"], "direction": e["event"], "previous_raw_seconds": number(e["previous_raw_s"]), "current_raw_seconds": number(e["raw_s"]), "corrected_time_seconds": number(e["out_s"])}
        for e in media.get("discontinuities", [])
    ]
    out = {
        "schema_version": 3,
        "input": {
            "source_id": media["source_id"], "content_type": media["source_type"], "path": media["source_path"], "file_size": byte(media.get("size", -1)),
            "duration_seconds": number(media["duration"]), "recoverable_decode_errors": media.get("decode_errors", 0), "dropped_packets": media.get("dropped_packets", 0),
            "timestamp_discontinuities": jumps,
        },
        "database_vector_count": vectors,
        "stored": vectors_after is not None,
    }
    if vectors_after is not None:
        out["database_vector_count_after"] = vectors_after
    out["matches"] = [
        {
            "feature": r["kind"], "extractor_id": r["extractor_id"], "anchor_count": r["anchor_count"], "similarity": number(r["similarity"]),
            "query": _place(r, "q_start", "q_end", "q_start_byte", "q_end_byte"),
            "reference": {"source_id": r["reference_id"], "name": r["reference_name"], "path": r["reference_path"], "content_type": r["reference_type"], **_place(r, "r_start", "r_end", "r_start_byte", "r_end_byte")},
        }
        for r in in_order(matches).collect()
    ]
    if inference is not None:
        out["content_families"] = [
            {
                "id": f["family_id"], "classification": f["classification"], "known_content_type": f["known_type"], "confidence": number(f["confidence"]), "typical_duration_seconds": number(f["typical"]),
                "has_audio": f["has_audio"], "has_video": f["has_video"], "audio_video_confirmed": f["confirmed"],
                "occurrences": [{"source_id": o["src"], "name": o["name"], "path": o["path"], "content_type": o["type"], **_place(o, "start_s", "end_s", "start_byte", "end_byte")} for o in f["occurrences"]],
            }
            for f in inference.families.orderBy("family").collect()
        ]
        out["timeline"] = [_segment(r) for r in inference.timeline.orderBy("seg").collect()]
        out["programme_guesses"] = [s for s in out["timeline"] if s["label"] == "programme"]
    return out


def dumps(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2) + "\n"


def match_json(matches: DataFrame) -> DataFrame:
    """source_id and one JSON text per match, for reports of many recordings at once."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    text = lambda c: F.round(F.col(c).cast("double"), 3)

    def side(name: str, *more: Column) -> Column:
        return F.struct(*more, known(f"{name}_start_byte").alias("start_byte"), known(f"{name}_end_byte").alias("end_byte"), text(f"{name}_start").alias("start_time_seconds"), text(f"{name}_end").alias("end_time_seconds"))

    row = F.struct(
        F.col("kind").alias("feature"), "extractor_id", "anchor_count", text("similarity").alias("similarity"), side("q").alias("query"),
        side("r", F.col("reference_id").alias("source_id"), F.col("reference_type").alias("content_type")).alias("reference"),
    )
    return matches.select("source_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("match"))
