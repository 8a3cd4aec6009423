"""Operator 6, MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of five lower-cased words. Documents with equal sets
form a class and are compared once. Classes whose signatures agree in one of 48 bands of six
are candidates: that misses one in ten thousand of the pairs at 0.75, and pairs below 0.4 seldom
take part. A candidate's signatures are compared a batch at a time: after m of n equal
values the posterior of the similarity s is Beta(m + 1, n - m + 1), and the pair is dropped as
soon as P(s >= threshold) falls below the miss probability. What survives is confirmed by
intersecting the full sets. Components come from ``linked_components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.graph import linked_components
from refrain.llm.scratch import Scratch, read
from refrain.llm.worker import kept

BANDS, ROWS, WORDS = 48, 6, 5
#: Words whose hashes a worker keeps.
CACHED = 400_000
MASK = (1 << 64) - 1


def shingle_hashes(text: str, cache: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words if there are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    if len(cache) > CACHED:
        cache.clear()
    for w in set(found):
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = min(words, len(ids))
    mixed = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def hash_parameters(size: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, MASK, size, np.uint64, endpoint=True) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value under each multiplication of 32 mixed bits; long sets go in blocks."""
    low, factors = (hashes >> np.uint64(17)).astype(np.uint32), factors.astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * factors[None, :]).min(axis=0), out)
    return out


def least_matches(threshold: float, miss: float, sizes: list[int]) -> dict[int, int]:
    """For n compared values, the fewest equal ones at which P(s >= threshold) >= miss."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in sizes:
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                break
        out[n] = m
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, k1, k2 (the set's hash), sig (16 bits a value), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, cache = hash_parameters(bands * rows), kept("near", "word hashes", dict)
        band_mix = hash_parameters(rows, 11)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                out = []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    hashes = shingle_hashes(text, cache, words) if text else np.empty(0, np.uint64)
                    if not len(hashes):
                        out.append((doc_id, 0, None, None, None, None))
                        continue
                    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    sig = signature(hashes, factors)
                    keys = np.zeros(bands, np.uint64) + np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        keys = (keys ^ sig.reshape(bands, rows)[:, k].astype(np.uint64)) * band_mix[k]
                        keys ^= keys >> np.uint64(31)
                    k1, k2 = np.array([key & MASK, key >> 64], np.uint64).view(np.int64)
                    out.append((doc_id, len(hashes), k1, k2, (sig >> np.uint32(16)).astype(np.uint16).tobytes(), signed(keys)))
                yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"]).astype(
                    {"doc_id": "Int64", "k1": "Int64", "k2": "Int64"}
                )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>")


def pruned(pairs: DataFrame, sketches: DataFrame, threshold: float, miss: float, batch: int, size: int) -> DataFrame:
    """The pairs(a, b) that batches of signature values do not rule out."""
    sizes = [*range(batch, size + 1, batch)]
    least = least_matches(threshold, miss, sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            alive, equal = np.arange(len(part)), np.zeros(len(part), np.int64)
            left, right = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(len(part), size) for c in ("sa", "sb"))
            for n in sizes:
                equal[alive] += (left[alive, n - batch : n] == right[alive, n - batch : n]).sum(axis=1)
                alive = alive[equal[alive] >= least[n]]
            yield part.iloc[alive][["a", "b"]]

    a, b = (sketches.select(F.col("doc_id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of hashes, as bytes, have 100 * intersection >= percent * union."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(p) + len(q) - len(np.union1d(p, q))
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def sifted(rows: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, miss: float, batch: int, size: int, block: int = 1024) -> DataFrame:
    """The links(a, b) between different components of rows(bucket, id, c, n).

    A bucket is cut into blocks of about ``block`` rows and a task compares two blocks, or one with
    itself, as arrays: signatures first, then the full sets of what these do not rule out. Pairs that
    are no links are never rows. A pair is compared in the first of the bands that it shares only.
    """
    sizes = [*range(batch, size + 1, batch)]
    least = least_matches(percent / 100, miss, sizes)

    def compare(part: pd.DataFrame) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), size)
        bands = np.stack(part["bands"])
        ids, c, own, hashes = (part[x].to_numpy() for x in ("id", "c", "own", "hashes"))
        bucket, across = part["bucket"].iloc[0], part["i"].iloc[0] != part["j"].iloc[0]
        values, counts = np.unique(c, return_counts=True)
        minor = c != values[counts.argmax()]
        out = []
        for x in np.flatnonzero(minor):
            others = (c != c[x]) & (~minor | (np.arange(len(c)) > x))
            alive = np.flatnonzero(others & (own != own[x]) if across else others)
            alive = alive[bands[x][(bands[alive] == bands[x]).argmax(axis=1)] == bucket]
            equal = np.zeros(len(alive), np.int64)
            for n in sizes:
                if not len(alive):
                    break
                equal += (sig[alive, n - batch : n] == sig[x, n - batch : n]).sum(axis=1)
                good = equal >= least[n]
                alive, equal = alive[good], equal[good]
            out += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in alive if similar(hashes[x], hashes[y], percent)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rest = ["bucket", "i", "j"], None
        for part in batches:
            rows = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(rows):
                continue
            key = rows[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts, len(rows)]
            got = [p for a, b in zip(bounds[:-2], bounds[1:-1], strict=True) for p in compare(rows.iloc[a:b])]
            yield pd.DataFrame(got, columns=["a", "b"], dtype="int64")
            rest = rows.iloc[bounds[-2] :]  # the last group may go on in the next batch
        if rest is not None and len(rest):
            yield pd.DataFrame(compare(rest), columns=["a", "b"], dtype="int64")

    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    full = dealt.join(sketches.select(F.col("doc_id").alias("id"), "sig", "bands"), "id").join(sets, "id")
    full = full.select("bucket", "i", "j", "id", "c", "own", "sig", "bands", "hashes")
    return full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the documents whose id is in ids(doc_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = kept("near", "word hashes", dict)
        for part in batches:
            for at in range(0, len(part), 500):
                rows = part.iloc[at : at + 500]
                yield pd.DataFrame({"id": rows["doc_id"], "hashes": [shingle_hashes(t or "", cache, words).tobytes() for t in rows["text"]]})

    # A merge join at every size, so that the shuffle grows as the texts do.
    return docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi").mapInPandas(run, "id long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            keep = [similar(x, y, percent) for x, y in zip(part["ha"], part["hb"], strict=True)]
            yield part.loc[keep, ["a", "b"]]

    a, b = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, percent: int = 75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6, batch: int = 32
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and link with nothing. Rows that share a
    doc_id count as one document; rows without doc_id are kept, in no component. Repeated rows
    give repeated results. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sketches = scratch.table(sketch(docs, words, bands, rows), "sketches")
    classes = sketches.filter("k1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.table(classes, "classes")
    reps = sketches.select("doc_id", "k1", "k2", "bands").join(classes, ["k1", "k2"]).filter("doc_id = rep")
    keyed = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket")
    buckets = scratch.table(keyed.join(shared, "bucket").distinct(), "buckets")
    members = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.table(full_sets(docs, members, words), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        return confirmed(pruned(pairs, sketches, percent / 100, miss, batch, bands * rows), sets, percent)

    def sift(rows_left: DataFrame) -> DataFrame:
        return sifted(rows_left, sketches, sets, percent, miss, batch, bands * rows)

    components = linked_components(buckets, verify, scratch, sift=sift)
    found = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return (
        sketches.select("doc_id", "n_shingles", "k1", "k2")
        .join(found, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
