"""A folder watcher: settled files go to a handler once, remembered in a state table."""

from __future__ import annotations

import json
import re
import shlex
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from datetime import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators.partition import PACKET

MANAGED = ("--input", "--output", "--no-programme-inference")
STATE = "key string, name string, size long, modified timestamp, signature string, ok boolean, at timestamp"


@dataclass(frozen=True)
class FolderConfig:
    name: str
    folder: str
    check_times: tuple[clock, ...]
    params: tuple[str, ...] = ()
    output_folder: str | None = None
    delete_source: bool = False
    mtime_over: float = 0.0
    enable: bool = True

    def __post_init__(self) -> None:
        if self.delete_source and not self.output_folder:
            raise ValueError("delete_source needs an output_folder")
        if self.mtime_over < 0:
            raise ValueError("mtime_over must not be negative")
        if bad := [p for p in self.params if p.split("=")[0] in MANAGED]:
            raise ValueError(f"managed options: {bad}")

    @property
    def signature(self) -> str:
        return json.dumps({"partition_version": 1, "params": self.params}, ensure_ascii=False, separators=(",", ":"))

    def key(self, path: str) -> str:
        """What a state row is about: this configuration's work on a file."""
        return "\n".join((self.name, self.output_folder or "<scan-only>", path))


def parse_times(value: str | list[str]) -> tuple[clock, ...]:
    parts = [p.strip() for p in (value.split(",") if isinstance(value, str) else value)]
    if not parts or not all(re.fullmatch(r"\d{1,2}:\d{2}", p) for p in parts):
        raise ValueError("check_time is HH:MM, or several")
    return tuple(sorted({clock(*map(int, p.split(":"))) for p in parts}))


def parse_config(text: str) -> list[FolderConfig]:
    """Configurations of a JSON array; unknown fields and wrong types are refused."""
    rows = json.loads(text)
    if not isinstance(rows, list) or not rows:
        raise ValueError("an array of folders")
    known = {"enable": bool, "name": str, "folder": str, "output_folder": str, "check_time": (str, list), "params": (str, list), "delete_source": bool, "mtime_over": (int, float)}
    out = []
    for row in rows:
        for k, v in row.items():
            if k not in known or (v is not None and not isinstance(v, known[k])) or (k == "mtime_over" and isinstance(v, bool)):
                raise ValueError(f"bad field {k}")
        params = row.get("params", [])
        out.append(
            FolderConfig(
                row["name"], row["folder"], parse_times(row["check_time"]), tuple(shlex.split(params) if isinstance(params, str) else params), row.get("output_folder"),
                row.get("delete_source", False), float(row.get("mtime_over", 0)), row.get("enable", True),
            )
        )
    return out


def latest_trigger(times: tuple[clock, ...], now: datetime) -> datetime | None:
    """The last of today's times that has passed."""
    past = [t for t in times if t <= now.time()]
    return datetime.combine(now.date(), past[-1]) if past else None


def due(files: DataFrame, state: DataFrame, config: FolderConfig, now: datetime) -> DataFrame:
    """Files (path, length, modificationTime) that are settled, hold a packet and are not yet done as they are now."""
    quiet = F.col("modificationTime") <= F.lit(now) - F.make_dt_interval(secs=F.lit(config.mtime_over))
    ready = files.filter(quiet & (F.col("length") >= PACKET))
    prefix = config.key("")
    own = state.filter(F.col("ok") & (F.col("signature") == config.signature) & F.col("key").startswith(prefix))
    done = own.select(F.substring("key", len(prefix) + 1, 1 << 20).alias("path"), F.col("size").alias("length"), F.col("modified").alias("modificationTime"))
    return ready.join(done, ["path", "length", "modificationTime"], "left_anti")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table, empty where there is none yet; one that cannot be read is an error, not a fresh start."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(path)


def run_once(spark: SparkSession, config: FolderConfig, state_path: str, handle: Callable[[str, FolderConfig], bool | None], now: datetime | None = None) -> tuple[int, int]:
    """Hands every file that is due to ``handle`` and records the outcome; (done, failed).

    Only names reach the driver, as many as one folder holds. A handler's error is an outcome; one that
    returns False wants the file again, and nothing is recorded.
    """
    from refrain.sources.media import folder_files

    now = now or datetime.now()
    state = read_state(spark, state_path)
    done = failed = 0
    for f in due(folder_files(spark, config.folder), state, config, now).collect():
        try:
            ok = handle(f["path"], config)
            if ok is False:
                continue
            ok = True
        except Exception as e:
            print(f"[{config.name}] failed {f['path']}: {e}", file=sys.stderr)
            ok = False
        done, failed = done + ok, failed + (not ok)
        row = (config.key(f["path"]), f["path"].rsplit("/", 1)[-1], f["length"], f["modificationTime"], config.signature, ok, now)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(state_path)  # at once: a later crash does not undo it
    return done, failed


def run_daemon(spark: SparkSession, configs: list[FolderConfig], state_path: str, handle: Callable[[str, FolderConfig], None], poll: float = 30.0, rounds: int | None = None) -> None:
    """Each configured time of a day triggers once; ``rounds`` bounds the polls."""
    seen: dict[str, datetime] = {}
    while rounds is None or rounds > 0:
        for c in configs:
            at = latest_trigger(c.check_times, datetime.now())
            if c.enable and at and seen.get(c.name) != at:
                seen[c.name] = at
                run_once(spark, c, state_path, handle)
        if rounds is not None:
            rounds -= 1
        if rounds != 0:
            time.sleep(poll)
