"""Operator 9, WARC archives with a globally ordered capture index, and reading them back.

Every task writes its pages as one archive of gzip members, a record each, and its captures as a
run sorted by URL key and timestamp. The runs are then merged: the key space is cut into ranges
at sampled keys, and a task merges its range of every run with a loser tree, streaming. A run is
opened where its sparse index says the range begins. With more runs than ``fan_in``, groups of
runs are first merged into longer ones.

Files are written under names of their own attempt and only counted when the task that wrote them
succeeds, so a retried or speculative task does no harm. They lie in the folder the cluster shares.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.scratch import Scratch, read

CRLF = b"\r\n"
SAMPLES = 16
#: Captures of one range of the merged index, roughly.
RANGE = 50_000


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased: a site's captures stand together."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:  # a host in brackets that is no address
        return (url or "").lower()
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return key.lower()


def capture_time(page_id: int | None) -> str:
    """Pages carry no time: a second each from 2000 on, by id."""
    seconds = (page_id or 0) % (10**9)
    return (datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    tail = record.rpartition(":")[2].rstrip(">")
    return None if tail in ("none", "") else int(tail)


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join("%%%02X" % ord(c) if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; first: the page whose equal payload this one revisits."""
    when = datetime.strptime(capture_time(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + 2 * CRLF + block + 2 * CRLF


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record."""
    head, _, rest = raw.partition(2 * CRLF)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != 2 * CRLF:
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(2 * CRLF)
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    page = page_of(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "revisit":
        return page, size, said, "revisit", page_of(fields["WARC-Refers-To"])
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said or len(payload) != size:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return page, size, digest, "response", None


def files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class LoserTree:
    """Merge of k sorted iterators: a tournament whose inner nodes keep the losers.

    After the winner leaves, its successor replays only the path to the root: log2(k) compares.
    """

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources, self.k = sources, len(sources)
        self.head = [next(s, None) for s in sources]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _enter(self, i: int) -> None:
        at = (i + self.k) // 2
        while at:
            if self.loser[at] < 0:
                self.loser[at] = i
                return
            if self._beats(self.loser[at], i):
                i, self.loser[at] = self.loser[at], i
            at //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[bytes]:
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.sources[w], None)
            at, i = (w + self.k) // 2, w
            while at:
                if self._beats(self.loser[at], i):
                    i, self.loser[at] = self.loser[at], i
                at //= 2
            self.loser[0] = i


class Run:
    """Writes sorted lines to a file; keeps every so manieth key with its byte."""

    def __init__(self, folder: str, name: str):
        self.fs, path = files(folder)
        self.path = f"{path}/{name}"
        self.out = self.fs.open_output_stream(self.path)
        self.at = self.n = 0
        self.step, self.marks = 1, []

    def add(self, line: bytes) -> None:
        if self.n % self.step == 0:
            self.marks.append((line, self.at))
            if len(self.marks) > 2 * SAMPLES:
                self.marks, self.step = self.marks[::2], self.step * 2
        self.out.write(line + b"\n")
        self.at += len(line) + 1
        self.n += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "n": self.n, "size": self.at, "keys": [k for k, _ in self.marks], "bytes": [b for _, b in self.marks]}


#: Keys that a payload's digest is dealt into.
SALT = 16
RUN_SCHEMA = "path string, n long, size long, keys array<binary>, bytes array<long>"


def lines_of(folder: str, run: dict, low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """The lines of a run with low <= line < high."""
    if not run["n"] or (high is not None and run["keys"][0] >= high):
        return
    start = max((b for k, b in zip(run["keys"], run["bytes"], strict=True) if low is not None and k <= low), default=0)
    fs, _ = files(folder)
    with fs.open_input_file(run["path"]) as f:
        f.seek(start)
        rest = b""
        while chunk := f.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if high is not None and line >= high:
                    return
                if low is None or line >= low:
                    yield line


def line_of(key: str, when: str, page_id: int | None, file: str, offset: int, length: int) -> bytes:
    """Tab-separated, sorting by key, time and id as bytes do; ids are shifted to be positive."""
    key = key.replace("\t", "%09").replace("\n", "%0A")
    order = "" if page_id is None else f"{page_id + (1 << 63):020d}"
    return "\t".join([key, when, order, file, str(offset), str(length)]).encode("utf-8", "surrogatepass")


def write_archives(pages: DataFrame, folder: str, least: int) -> DataFrame:
    """Writes archives and sorted runs below folder; returns the runs, one row per task."""
    typed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"digest": F.sha2("html", 256), "n": F.octet_length("html")}
    )
    firsts = typed.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # A digest with many copies is SALT keys of the join, not one: its payloads do not meet in one task.
    firsts = firsts.filter("copies > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = typed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    typed = salted.join(firsts, ["digest", "salt"], "left")
    typed = typed.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        fs, path = files(folder)
        name = uuid.uuid4().hex
        out, offset, captures = None, 0, []
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                page_id, first = (None if x == "" else int(x) for x in (page_id, first))
                out = out or fs.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)) + z.flush()
                out.write(member)
                captures.append(line_of(url_key(url), capture_time(page_id), page_id, name, offset, len(member)))
                offset += len(member)
        if out is None:
            return
        out.close()
        own = Run(folder, f"{name}.run")
        for line in sorted(captures):
            own.add(line)
        yield pd.DataFrame([own.close()])

    ids = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "first")}
    return typed.withColumns(ids).select("page_id", "url", "html", "digest", "first").mapInPandas(run, RUN_SCHEMA)


def merged(spark: SparkSession, scratch: Scratch, folder: str, runs: list[dict], fan_in: int) -> DataFrame:
    """The index: range, place, url_key, captured, page_id, file, offset, length, in global order."""
    while len(runs) > fan_in:
        groups = [runs[i : i + fan_in] for i in range(0, len(runs), fan_in)]

        def join(batches: Iterator[pd.DataFrame], groups=groups) -> Iterator[pd.DataFrame]:
            import uuid

            for batch in batches:
                for g in batch["id"]:
                    own = Run(folder, f"{uuid.uuid4().hex}.run")
                    for line in LoserTree([lines_of(folder, r, None, None) for r in groups[g]]):
                        own.add(line)
                    yield pd.DataFrame([own.close()])

        each = spark.range(0, len(groups), 1, len(groups)).mapInPandas(join, RUN_SCHEMA)
        runs = [r.asDict() for r in scratch.table(each, "runs").collect()]
    total = sum(r["n"] for r in runs)
    keys = sorted(bytes(k) for r in runs for k in r["keys"])
    parts = max(1, min(len(keys), -(-total // RANGE)))
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)})
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    runs = [r | {"keys": [bytes(k) for k in r["keys"]]} for r in runs]

    def join_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["range", "place", "url_key", "captured", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

        for batch in batches:
            for g in batch["id"]:
                rows, low_high = [], bounds[g]
                for place, line in enumerate(LoserTree([lines_of(folder, r, *low_high) for r in runs])):
                    key, when, order, file, offset, length = line.decode("utf-8", "surrogatepass").split("\t")
                    rows.append((g, place, key, when, int(order) - (1 << 63) if order else None, file, int(offset), int(length)))
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    schema = "range long, place long, url_key string, captured string, page_id long, file string, offset long, length long"
    return scratch.table(spark.range(0, len(bounds), 1, len(bounds)).mapInPandas(join_range, schema), "index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture.

    Captures are gathered by archive and read in the order they lie there; responses are
    checked against their digest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = files(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length, key, captured in zip(*(batch[c] for c in ("file", "offset", "length", "url_key", "captured")), strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, fs.open_input_file(f"{path}/{file}.warc.gz")
                f.seek(offset)
                rows.append((*parse(zlib.decompress(f.read(length), 31)), key, captured))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if f:
            f.close()

    # A file's captures stay together only as far as a partition goes: any split of them reads well.
    ordered = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string"
    return ordered.mapInPandas(run, schema)


def archive(pages: DataFrame, *, least: int = 100, fan_in: int = 64) -> tuple[DataFrame, str]:
    """The merged index of newly written archives, and their folder.

    Null html is an empty payload, null url has the empty key. Of equal payloads of at least
    ``least`` bytes the smallest page_id's record is the response (each of them, if it repeats)
    and others revisit it; payloads of pages without id revisit the smallest id there is, or are
    responses if there is none. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.folder}/archives"
    path, fs = scratch._path(folder)
    fs.mkdirs(path)
    runs = [r.asDict() for r in scratch.table(write_archives(pages, folder, least), "runs").collect()]
    return merged(spark, scratch, folder, runs, fan_in), folder


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive(read(spark, sf_dir, "pages"))
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
