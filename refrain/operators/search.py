"""Similarity top-k joins over 8-bit quantised vectors, exact or by locality-sensitive hashing.

Tables of vectors have: source_id, source_name, source_path, source_type, extractor_id, kind,
start_s, end_s, start_byte, end_byte, values array<float>; stored ones ``sequence``, q and
q_norm instead of values. Only equal (extractor_id, kind, length) are ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import lsh
from refrain.functions.vectors import asymmetric_score, normalised, quantised, quantised_norm, squared_norm
from refrain.options import AUDIO_SPACE, EXACT_LIMIT, VIDEO_SPACE, SearchOptions
from refrain.sources.store import checkpointed

META = ("source_id", "source_name", "source_path", "source_type", "extractor_id", "kind", "start_s", "end_s", "start_byte", "end_byte")
#: Rows of a side that one task compares at once where both sides are dealt into blocks.
BLOCK = 8192
SPACE = ("extractor_id", "kind", "dim")
HIT = ["ref_source_id", "ref_source_name", "ref_source_path", "ref_source_type", "ref_start_s", "ref_end_s", "ref_start_byte", "ref_end_byte"]


def base_vectors(recordings: DataFrame, buckets: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Vectors to search with: every bucket's video and audio, or the audio windows where a source
    has some. Empty vectors and those without direction are left out."""
    named = recordings.select("source_id", "source_name", "source_path", "source_type")

    def part(df: DataFrame, kind: str, space: str, values: str) -> DataFrame:
        return df.select(
            "source_id", F.lit(space).alias("extractor_id"), F.lit(kind).alias("kind"), "start_s", "end_s", "start_byte", "end_byte", F.col(values).alias("values")
        )

    audio = buckets
    if windows is not None:
        audio = buckets.join(windows.select("source_id").distinct(), "source_id", "left_anti")
    out = part(buckets, "video_perceptual", VIDEO_SPACE, "video").unionByName(part(audio, "audio_spectrum", AUDIO_SPACE, "audio"))
    if windows is not None:
        out = out.unionByName(part(windows, "audio_spectrum", AUDIO_SPACE, "values"))
    good = out.filter(F.col("values").isNotNull() & (squared_norm(F.col("values")) > 1e-12))
    return good.join(named, "source_id").select(*META, "values")


def stored(vectors: DataFrame, sequence: Column | None = None) -> DataFrame:
    """Vectors as a catalogue keeps them."""
    unit = vectors.withColumn("unit", normalised(F.col("values"))).filter(F.col("unit").isNotNull())
    out = unit.withColumn("q", quantised(F.col("unit")))
    out = out.withColumn("q_norm", quantised_norm(F.col("q"))).filter("q_norm > 0")
    return out.withColumn("sequence", sequence if sequence is not None else F.lit(0).cast("long")).drop("unit", "values")


def _score(query: np.ndarray, q: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, as asymmetric_score has them: 32-bit products, summed in order."""
    products = (query * q.astype(np.float32)).astype(np.float64)
    return (np.add.accumulate(products, axis=1)[:, -1] / q_norm.astype(np.float64)).astype(np.float32)


def _unit(values: np.ndarray) -> np.ndarray:
    n = np.add.accumulate(values.astype(np.float64) ** 2, axis=1)[:, -1]
    return values * (1 / np.sqrt(n)).astype(np.float32)[:, None]


def _best(query: np.ndarray, ref: dict, threshold: np.float32, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row the places of its k best references and their scores."""
    for at in range(0, len(query), 256):
        rough = query[at : at + 256].astype(np.float64) @ ref["q"].T.astype(np.float64) / ref["q_norm"]
        for i, row in enumerate(rough):
            low = float(threshold) - 1e-5
            if k < len(row):
                low = max(low, np.partition(row, -k)[-k] - 1e-5)
            near = np.flatnonzero(row >= low)
            exact = _score(np.broadcast_to(query[at + i], (len(near), query.shape[1])), ref["q"][near], ref["q_norm"][near])
            near, exact = near[exact >= threshold], exact[exact >= threshold]
            order = np.lexsort((near, -exact))[:k]  # references lie in order of sequence, source and start
            yield at + i, near[order], exact[order]


def _ordered(rows: list) -> list:
    return sorted(rows, key=lambda r: (r["sequence"], r["source_id"], r["start_s"], r["end_s"]))


def _in_blocks(rows: DataFrame, own: str, other: str, blocks: int, others: Column) -> DataFrame:
    """rows with ``own``, the block that a row's hash deals it into, once for each block ``other`` in others."""
    return rows.withColumn(own, F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int")).withColumn(other, F.explode(others))


def _blocked_top_k(queries: DataFrame, catalogue: DataFrame, k: int, threshold: float) -> DataFrame:
    """exact_top_k for catalogues of any size: every block of queries meets every block of stored vectors."""
    asked = queries.filter(squared_norm(F.col("values")) > 1e-20).withColumn("query", F.monotonically_increasing_id().cast("string"))
    asked = checkpointed(asked)  # the ids must not change between its uses, and are text, which stays exact beside nulls
    kept = catalogue.select("extractor_id", "kind", F.size("q").alias("dim"), "sequence", "q", "q_norm", *[F.col(c.removeprefix("ref_")).alias(c) for c in HIT])
    n, m = (max(1, -(-df.count() // BLOCK)) for df in (asked, kept))
    left = asked.select("query", "extractor_id", "kind", F.size("values").alias("dim"), "values")
    left = _in_blocks(left, "x", "y", n, F.sequence(F.lit(0), F.lit(m - 1)))
    right = _in_blocks(kept, "y", "x", m, F.sequence(F.lit(0), F.lit(n - 1)))
    limit, columns = np.float32(threshold), ["query", "similarity", "sequence", *HIT]

    def run(both: pd.DataFrame) -> pd.DataFrame:
        a, b = both[both["query"].notna()], both[both["query"].isna()]
        if a.empty or b.empty:
            return both.assign(similarity=np.float32(0))[columns].iloc[:0]
        b = b.sort_values(["sequence", "ref_source_id", "ref_start_s", "ref_end_s"], kind="stable").reset_index(drop=True)
        ref = {"q": np.stack(b["q"]).astype(np.int8), "q_norm": b["q_norm"].to_numpy(np.float32)}
        take, places, scores = [], [], []
        for i, near, score in _best(_unit(np.stack(a["values"]).astype(np.float32)), ref, limit, k):
            take += [i] * len(near)
            places += list(near)
            scores += list(score)
        out = b.iloc[places].reset_index(drop=True)
        out["query"], out["similarity"] = a["query"].to_numpy()[take], np.array(scores, np.float32)
        return out[columns]

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = ", ".join(["query string, similarity float", *(f"{c} {types[c]}" for c in columns[2:])])
    left = left.withColumns({c: F.lit(0).cast("long") for c in ("sequence", "ref_start_byte", "ref_end_byte")})  # nulls would make them floats
    found = left.unionByName(right, allowMissingColumns=True).groupBy(*SPACE, "x", "y").applyInPandas(run, schema)
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "sequence", "ref_source_id", "ref_start_s", "ref_end_s")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked, "query").select(*[c for c in queries.columns if c != "values"], "similarity", "rank", *HIT)


def exact_top_k(queries: DataFrame, catalogue: DataFrame, k: int, threshold: float) -> DataFrame:
    """queries with similarity, rank and the HIT columns of their k best stored vectors.

    Catalogues of at most EXACT_LIMIT vectors are sent to every task, and a query is answered
    where it stands, without a shuffle; larger ones are compared in blocks.
    """
    rows = catalogue.select(*META, "sequence", F.size("q").alias("dim"), "q", "q_norm").limit(EXACT_LIMIT + 1).collect()
    if len(rows) > EXACT_LIMIT:
        return _blocked_top_k(queries, catalogue, k, threshold)
    spaces: dict[tuple, dict] = {}
    for r in _ordered(rows):
        spaces.setdefault((r["extractor_id"], r["kind"], r["dim"]), []).append(r)
    spaces = {
        key: {
            "q": np.array([r["q"] for r in own], np.int8),
            "q_norm": np.array([r["q_norm"] for r in own], np.float32),
            "hit": [tuple(r[c] for c in ("source_id", "source_name", "source_path", "source_type", "start_s", "end_s", "start_byte", "end_byte")) for r in own],
        }
        for key, own in spaces.items()
    }
    limit = np.float32(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = list(zip(batch["extractor_id"], batch["kind"], batch["values"].map(len), strict=True))
            for key in dict.fromkeys(keys):
                if key not in spaces:
                    continue
                part = batch[[x == key for x in keys]]
                unit = _unit(np.stack(part["values"]).astype(np.float32))
                take, hits = [], []
                for i, near, score in _best(unit, spaces[key], limit, k):
                    take += [i] * len(near)
                    hits += [(float(s), n + 1, *spaces[key]["hit"][j]) for n, (j, s) in enumerate(zip(near, score, strict=True))]
                out = part.iloc[take].drop(columns="values").reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(hits, columns=["similarity", "rank", *HIT])], axis=1)

    fields = {f.name: f.dataType.simpleString() for f in queries.schema if f.name != "values"}
    schema = ", ".join([*(f"{k} {v}" for k, v in fields.items()), "similarity float, rank int", "ref_source_id string, ref_source_name string, ref_source_path string, ref_source_type string", "ref_start_s double, ref_end_s double, ref_start_byte long, ref_end_byte long"])
    good = queries.filter(squared_norm(F.col("values")) > 1e-20)
    return good.select(*fields, "values").mapInPandas(run, schema)


def _blocked_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """similar_pairs for any number of rows: every block meets itself and those after it."""
    good = rows.filter(squared_norm(F.col("v")) > 1e-18).select("id", "v", F.size("v").alias("dim"))
    n = max(1, -(-good.count() // BLOCK))
    dealt = _in_blocks(good, "own", "other", n, F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    limit = np.float32(threshold)

    def run(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        a, b = (both[both["own"] == block] for block in key[1:])
        out = [pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64), "cosine": np.array([], np.float32)})]
        if len(a) and len(b):
            ids, ref = b["id"].to_numpy(), np.stack(b["v"]).astype(np.float64)
            rr = np.add.accumulate(ref * ref, axis=1)[:, -1]
            for i, v in zip(a["id"], a["v"], strict=True):
                x = v.astype(np.float64)
                xx = np.add.accumulate(x * x)[-1]
                other = ids > i if key[1] == key[2] else ids != i
                near = np.flatnonzero((ref @ x >= (threshold - 1e-5) * np.sqrt(rr * xx)) & other)
                exact = (np.add.accumulate(ref[near] * x, axis=1)[:, -1] / np.sqrt(xx * rr[near])).astype(np.float32)
                near, exact = near[exact >= limit], exact[exact >= limit]
                out.append(pd.DataFrame({"a": np.minimum(ids[near], i), "b": np.maximum(ids[near], i), "cosine": exact}))
        return pd.concat(out, ignore_index=True)

    return dealt.groupBy("dim", "x", "y").applyInPandas(run, "a long, b long, cosine float")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine), a < b, of rows(id, v) of equal length with at least that cosine.

    At most EXACT_LIMIT rows are sent to every task; more are dealt into blocks, which are compared in pairs.
    """
    known = rows.limit(EXACT_LIMIT + 1).collect()
    if len(known) > EXACT_LIMIT:
        return _blocked_pairs(rows, threshold)
    spaces: dict[int, tuple] = {}
    for size in {len(r["v"]) for r in known}:
        own = [r for r in known if len(r["v"]) == size]
        spaces[size] = np.array([r["id"] for r in own]), np.array([r["v"] for r in own], np.float32).astype(np.float64)
    limit = np.float32(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len).to_numpy()):
                ids, ref = spaces[size]
                rr = np.add.accumulate(ref * ref, axis=1)[:, -1]
                for i, v in zip(part["id"], part["v"], strict=True):
                    x = v.astype(np.float64)
                    xx = np.add.accumulate(x * x)[-1]
                    near = np.flatnonzero((ref @ x >= (threshold - 1e-5) * np.sqrt(rr * xx)) & (ids > i))
                    exact = (np.add.accumulate(ref[near] * x, axis=1)[:, -1] / np.sqrt(xx * rr[near])).astype(np.float32)
                    yield pd.DataFrame({"a": i, "b": ids[near][exact >= limit], "cosine": exact[exact >= limit]})

    good = rows.filter(squared_norm(F.col("v")) > 1e-18)
    return good.select("id", "v").mapInPandas(run, "a long, b long, cosine float")


def hash_rows(vectors: DataFrame, column: str, keep: list[str], masks: list[int] | None = None) -> DataFrame:
    """keep, table, hash: a row per table, or per table and mask of changed bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch[column].map(len)
            for _, part in batch.groupby(sizes.to_numpy()):
                hashes = lsh.signatures(np.stack(part[column]))
                yield part[keep].assign(hashes=list(hashes.astype(np.int64)))

    fields = {f.name: f.dataType.simpleString() for f in vectors.select(*keep).schema}
    hashed = vectors.select(*keep, column).mapInPandas(run, ", ".join([*(f"{k} {v}" for k, v in fields.items()), "hashes array<long>"]))
    rows = hashed.select(*keep, F.posexplode("hashes").alias("table", "hash"))
    if masks is not None:
        rows = rows.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("hash", F.col("hash").bitwiseXOR(F.col("mask").cast("long"))).drop("mask")
    return rows


def lsh_candidates(asked: DataFrame, kept: DataFrame, keys: list[str], fewest: int | None) -> DataFrame:
    """(query, ref) of asked(query, keys, unit) and kept(ref, keys, q): equal hashes, or one changed
    bit, in any table. Queries with fewer than ``fewest`` also probe two changed bits; None: none do."""
    index = hash_rows(kept, "q", ["ref", *keys]).select(*keys, "table", "hash", "ref")

    def found(rows: DataFrame, masks: list[int]) -> DataFrame:
        return hash_rows(rows, "unit", ["query", *keys], masks).join(index, [*keys, "table", "hash"]).select("query", "ref").distinct()

    near = found(asked, lsh.flips(1))
    if fewest is None:
        return near
    few = asked.join(near.groupBy("query").count(), "query", "left").filter(F.coalesce("count", F.lit(0)) < fewest).drop("count")
    two = [m for m in lsh.flips(2) if bin(m).count("1") == 2]
    return near.unionByName(found(few, two)).distinct()


def lsh_top_k(queries: DataFrame, catalogue: DataFrame, k: int, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The same columns as exact_top_k by equi-joins on (space, table, hash).

    A query probes its own hash and those of one changed bit in each table; queries that find
    fewer than max(64, 8 k) vectors also probe those of two. ``by`` names more columns that must be equal.
    """
    keys = [*SPACE, *by]
    asked = queries.filter(squared_norm(F.col("values")) > 1e-20).withColumns(
        {"query": F.monotonically_increasing_id(), "dim": F.size("values"), "unit": normalised(F.col("values"))}
    )
    asked = checkpointed(asked)  # the ids of the queries must not change between its uses
    kept = checkpointed(catalogue.withColumns({"dim": F.size("q"), "ref": F.monotonically_increasing_id()}))
    pairs = lsh_candidates(asked, kept, keys, max(64, 8 * k))
    hits = kept.select("ref", "sequence", "q", "q_norm", *[F.col(c.removeprefix("ref_")).alias(c) for c in HIT])
    scored = pairs.join(asked, "query").join(hits, "ref").withColumn("similarity", asymmetric_score(F.col("unit"), F.col("q"), F.col("q_norm")))
    scored = scored.filter(F.col("similarity") >= F.lit(threshold).cast("float"))
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "sequence", "ref_source_id", "ref_start_s", "ref_end_s")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(*[c for c in queries.columns if c != "values"], "similarity", "rank", *HIT)


def top_k(queries: DataFrame, catalogue: DataFrame, k: int, threshold: float, method: str = "auto") -> DataFrame:
    """By exact_top_k or lsh_top_k as ``method`` says; auto is exact for catalogues of at most EXACT_LIMIT vectors of all spaces."""
    if method == "auto":
        method = "exact" if catalogue.select(F.lit(1)).limit(EXACT_LIMIT + 1).count() <= EXACT_LIMIT else "hashed"
    return (exact_top_k if method == "exact" else lsh_top_k)(queries, catalogue, k, threshold)


def catalogue_anchors(queries: DataFrame, catalogue: DataFrame, options: SearchOptions) -> DataFrame:
    """Hits in other sources. Those in the own source take up places among the k and go afterwards."""
    return top_k(queries, catalogue, options.top_k, options.minimum_similarity, options.method).filter("ref_source_id != source_id")


def self_anchors(queries: DataFrame, options: SearchOptions) -> DataFrame:
    """Hits of each source in itself, forward by at least the least duration.

    Sources of at most EXACT_LIMIT vectors are searched whole, one group each; longer ones by hashing, but for
    options.method to say otherwise.
    """
    k, limit = options.self_k, np.float32(options.minimum_similarity)
    counted = queries.join(queries.groupBy("source_id").agg(F.count("*").alias("n")), "source_id")
    most = {"auto": EXACT_LIMIT, "exact": 2**62, "hashed": 0}[options.method]
    short = stored(counted.filter(F.col("n") <= most).withColumn("v", F.col("values"))).withColumn("dim", F.size("q"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_s", "end_s"], kind="stable").reset_index(drop=True)
        ref = {"q": np.stack(rows["q"]).astype(np.int8), "q_norm": rows["q_norm"].to_numpy(np.float32)}
        take, places, scores, ranks = [], [], [], []
        for i, near, score in _best(_unit(np.stack(rows["v"]).astype(np.float32)), ref, limit, k):
            take += [i] * len(near)
            places += list(near)
            scores += list(map(float, score))
            ranks += range(1, len(near) + 1)
        out = rows.iloc[take][list(META)].reset_index(drop=True)
        hits = rows.iloc[places].reset_index(drop=True)
        out["similarity"], out["rank"] = np.array(scores, np.float32), np.array(ranks, np.int32)
        for c in HIT:
            out[c] = hits[c.removeprefix("ref_")]
        return out

    types = {f.name: f.dataType.simpleString() for f in queries.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in META), "similarity float, rank int", *(f"{c} {types[c.removeprefix('ref_')]}" for c in HIT)])
    hits = short.groupBy("source_id", *SPACE).applyInPandas(run, schema)
    long = counted.filter(F.col("n") > most).select(*META, "values")
    if not long.isEmpty():
        hits = hits.unionByName(lsh_top_k(long, stored(long), k, options.minimum_similarity, ("source_id",)).select(*hits.columns))
    return hits.filter(F.col("ref_start_s") - F.col("start_s") + 1e-6 >= options.minimum_duration_seconds)
