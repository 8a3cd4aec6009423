"""Operator 1, embedding near-dedup: spherical k-means cells and blocked cosines within them.

Vectors of a label that are equal form a class, which is compared once under a number of its own; vec_ids
may repeat. Cells come from a bounded sample. Every class belongs to the cell of its nearest centre,
its home. Within the chord of the threshold of it lie all its neighbours, and moving a unit vector by
that chord changes its lead of one centre over another by at most chord * |difference of the centres|.
That bounds which other cells can be a neighbour's home: a class visits those with a smaller number, as a
guest, and is compared with the residents there only. So no link is lost at a cell's border and each
pair meets in one cell.

A cell's residents are cut into blocks by their cosine to the centre: a neighbour's differs by at most the chord,
so that a block meets only the blocks near it on that line, and a guest only the blocks that it can reach. A task
multiplies two blocks and returns a row per class that has links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.graph import connected_components
from refrain.llm.scratch import Scratch, read

CELL, BLOCK, SAMPLE, MOST_CELLS = 1000, 1024, 16_384, 4096
#: Slices of a cell's line for each block; rows that meet a block at once.
SLICES, STRIPE = 32, 1024


def usable(v: Column) -> Column:
    """A vector with a direction: not null, no null or non-finite component, not zero."""
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(number, F.lit(False)) & F.exists(v, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres on the unit sphere; each is the direction of its members' sum."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def compare(key: tuple, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the residents of a block, key[-1], among each other and with all other rows.

    a, links, b: a class, its number of linked vectors here, and the least class of a's part.
    """
    x = np.stack([np.frombuffer(v, np.float64) for v in rows["v"]])
    ids, n, here = rows["class"].to_numpy(), rows["n"].to_numpy(), np.flatnonzero(rows["own"].to_numpy())
    links, part = np.zeros(len(ids), np.int64), np.arange(len(ids))
    place = np.full(len(ids), -1)
    place[here] = np.arange(len(here))

    def top(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for at in range(0, len(ids), STRIPE):  # so that a block's products stay small however many rows meet it
        stripe = np.arange(at, min(at + STRIPE, len(ids)))
        linked = x[stripe] @ x[here].T >= threshold
        inner = place[stripe] >= 0
        linked[inner, place[stripe[inner]]] = False
        links[stripe] += linked @ n[here]
        links[here] += n[stripe[~inner]] @ linked[~inner]
        for i in np.flatnonzero(linked.any(axis=1)):
            for j in here[linked[i]]:
                a, b = top(stripe[i]), top(j)
                if a != b:
                    part[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    busy = np.flatnonzero(links)
    return pd.DataFrame({"a": ids[busy], "links": links[busy], "b": ids[[top(i) for i in busy]]}, dtype="int64")


def embedding_duplicates(vectors: DataFrame, *, threshold: float = 0.98, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal length are compared. Vectors that are null,
    zero or hold null or non-finite components, and rows without vec_id, link with nothing; the
    latter have no component and are kept. Rows that repeat a vec_id are vectors of their own, each with its
    own links, under one id. At most ``sample`` vectors reach the driver, for the centres. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    base = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    # A class is known by its hash, of both halves of which the numbers below take the first.
    named = base.withColumn("ok", ok).withColumns({"k1": F.when(ok, F.xxhash64("label", "v")), "k2": F.when(ok, F.xxhash64(F.lit(1), "v", "label"))})
    rows = scratch.table(named.select("vec_id", "k1", "k2"), "rows")
    grouped = named.filter("ok").groupBy("k1", "k2").agg(F.min(F.struct("label", "v")).alias("x"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.table(grouped.select("k1", "k2", "x.label", "x.v", "rep", "n", F.monotonically_increasing_id().alias("class")), "classes")

    total = classes.count()
    centres = fitted_centres(classes, total, cell, sample)
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def scored(rows: pd.DataFrame) -> Iterator[tuple]:
        for d, part in rows.groupby(rows["v"].map(len).to_numpy()):
            x = unit(np.stack(part["v"]).astype(float))
            c = centres[d] if d in centres else np.zeros((1, d))  # a length that the sample lacks: one cell
            score = x @ c.T
            yield d, part, x, c, score, score.argmax(axis=1)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                for d, part, _, _, score, own in scored(batch.iloc[at : at + 2000]):
                    yield pd.DataFrame({"dim": d, "cell": own, "along": score[np.arange(len(part)), own]})

    # How far from the centre residents of a cell are at most: one row a cell.
    far = classes.select("v").mapInPandas(homes, "dim int, cell int, along double").groupBy("dim", "cell").agg(F.min("along").alias("low")).collect()
    lowest = {(r["dim"], r["cell"]): r["low"] for r in far}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart = {d: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) + 1e-7 for d, c in centres.items() if len(c) <= 4096}
        for batch in batches:
            for at in range(0, len(batch), 2000):
                for d, part, x, c, score, own in scored(batch.iloc[at : at + 2000]):
                    low = np.array([lowest.get((d, k), 2.0) for k in range(len(c))])
                    near = (score[np.arange(len(x)), own][:, None] - score <= chord * apart[d][own]) if d in apart else np.ones_like(score, bool)
                    near &= (np.arange(len(c))[None, :] <= own[:, None]) & (score >= low[None, :] - chord)
                    near[np.arange(len(x)), own] = True
                    where, cells = np.nonzero(near)
                    got = part.iloc[where][["label", "class", "n"]].copy()
                    got["dim"], got["cell"], got["own"], got["along"] = d, cells, cells == own[where], score[where, cells]
                    got["v"] = [x[i].tobytes() for i in where]
                    yield got[["label", "dim", "cell", "class", "n", "own", "along", "v"]]

    label_type = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "v", "class", "n").mapInPandas(assign, f"label {label_type}, dim int, cell int, class long, n long, own boolean, along double, v binary")
    placed = scratch.table(placed, "placed")
    linked = scratch.table(blocked(placed, chord, block, threshold), "linked")
    scratch.drop(placed)
    components = connected_components(linked.select("a", "b"), scratch)
    found = classes.select("k1", "k2", "class", "n", "rep").join(linked.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links")), "class", "left")
    found = found.join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    low = found.groupBy("component").agg(F.min("rep").alias("low"))
    found = found.join(low, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "low")
    # Rows without a class do not take part in the join: they would all have one key.
    good = rows.filter("k1 IS NOT NULL").join(found, ["k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), F.col("low").alias("component_id"))
    bad = rows.filter("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def fitted_centres(classes: DataFrame, total: int, cell: int, sample: int) -> dict[int, np.ndarray]:
    """Centres by length of vector, from about ``sample`` classes: those with the least hashes.

    The hash is cut where that many are expected, so that nothing is sorted.
    """
    share = min(1.0, sample / max(1, total))
    cut = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    drawn = classes.filter(F.xxhash64("k1", F.lit(9)) <= cut).select("v").limit(2 * sample).collect()
    centres: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in drawn}:
        x = unit(np.array([r["v"] for r in drawn if len(r["v"]) == size], float))
        own = total * len(x) / len(drawn)
        centres[size] = spherical_kmeans(x, int(min(MOST_CELLS, len(x), max(1, -(-own // cell)))))
    return centres


def blocked(placed: DataFrame, chord: float, block: int, threshold: float) -> DataFrame:
    """compare() of every block of residents with the later blocks and the guests that it can reach."""
    where = ["label", "dim", "cell"]
    residents = placed.filter("own").select(*where, "along", "class")
    sizes = residents.groupBy(*where).agg(F.count("*").alias("m"), F.min("along").alias("low"), F.max("along").alias("high"))
    # Many more slices than blocks, counted; a block is the slices whose running count falls in it.
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("m") / block).cast("long"), "width": (F.col("high") - F.col("low")) / (SLICES * F.ceil(F.col("m") / block)) + 1e-12})
    slice_of = F.floor((F.col("along") - F.col("low")) / F.col("width")).cast("long")
    counts = residents.join(sizes, where).groupBy(*where, slice_of.alias("slice")).agg(F.count("*").alias("k"), F.first("low").alias("low"), F.first("width").alias("width"))
    upto = Window.partitionBy(*where).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("block", F.floor(F.coalesce(F.sum("k").over(upto), F.lit(0)) / block).cast("int"))
    # A slice that holds more than a block (many vectors at one cosine) is dealt by hash.
    cut = cut.withColumn("deals", F.ceil(F.col("k") / block).cast("int"))
    spans = cut.groupBy(*where, "block").agg((F.min("slice") * F.first("width") + F.first("low")).alias("from"), ((F.max("slice") + 1) * F.first("width") + F.first("low")).alias("to"), F.max("deals").alias("deals"))
    spans = spans.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("block", "from", "to", "deals"))).alias("spans"))

    own = placed.filter("own").join(sizes.drop("m", "high", "blocks"), where).withColumn("slice", slice_of).drop("low", "width")
    own = own.join(cut.select(*where, "slice", "block"), [*where, "slice"]).drop("slice")
    guests = placed.filter("NOT own").withColumn("block", F.lit(None).cast("int"))
    both = own.unionByName(guests).join(spans, where)
    reach = F.filter("spans", lambda s: (s["to"] + chord >= F.col("along")) & (s["from"] - chord <= F.col("along")) & (F.col("block").isNull() | (s["block"] <= F.col("block"))))
    met = both.withColumn("met", F.explode(reach)).drop("spans")
    dealt = F.pmod(F.xxhash64("class"), F.col("met.deals")).cast("int")
    home = F.coalesce(F.col("met.block") == F.col("block"), F.lit(False))
    met = met.withColumns({"home": home, "mine": dealt, "deal": F.explode(F.sequence(F.lit(0), F.col("met.deals") - 1))})
    # Of two deals of one block the rows of the later one visit the earlier.
    met = met.filter(~F.col("home") | (F.col("deal") <= F.col("mine")))
    met = met.select(*where, "class", "n", "v", F.col("met.block").alias("at"), "deal", (F.col("home") & (F.col("deal") == F.col("mine"))).alias("own"))
    return met.groupBy(*where, "at", "deal").applyInPandas(lambda key, part: compare(key, part, threshold), "a long, links long, b long")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))
