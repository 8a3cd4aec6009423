"""Names, ids and clock texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: str) -> str:
    """64-bit FNV-1a in hex, without leading zeros."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:x}"


def source_id(path_and_size: Column) -> Column:
    """Unsigned 64-bit products have no SQL type here, hence an Arrow function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fnv1a, na_action="ignore")

    return run(path_and_size)


def clock(seconds: Column, up: bool = False) -> Column:
    """HH-MM-SS, rounded down, or up for the end of a part."""
    s = F.greatest((F.ceil(seconds) if up else F.floor(seconds)).cast("long"), F.lit(0).cast("long"))
    return F.format_string("%02d-%02d-%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def clock_text(seconds: Column) -> Column:
    return F.replace(clock(seconds), F.lit("-"), F.lit(":"))


def part_name(stem: Column, number: Column, kind: Column, start: Column, end: Column, suffix: str = ".ts") -> Column:
    return F.concat(stem, F.format_string(".part%03d_%s_", number, kind), clock(start), F.lit("_"), clock(end, True), F.lit(suffix))
