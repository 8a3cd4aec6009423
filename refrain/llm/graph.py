"""Components of a graph whose edges and labels stay distributed, and of buckets of candidates.

Everything here is DataFrame joins and aggregates that combine before they shuffle. Each round
is written to the shared folder, which cuts the lineage, in as many files as its rows need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.scratch import Scratch

#: Rows of two or three integers that one task of a graph step should see at least.
TASK_ROWS = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of at least TASK_ROWS rows, where at most ``rows`` are expected; no shuffle."""
    return df.coalesce(max(4, -(-rows // TASK_ROWS)))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a long, b long) -> (node, component), component the smallest node reachable.

    A distributed union-find. Every root hooks itself to its smallest neighbour (the links only
    go down, so they form trees), pointer jumping flattens the trees, edges are rewritten to
    roots and those inside a tree vanish. Rounds and jumps are logarithmic in the number of
    nodes and in the depth of a tree; a hub with many edges is one combined row per task.
    """
    live = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = scratch.table(live, "edges")
    labels = None
    while rows := live.count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        trees = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        trees = scratch.table(_few(trees, 2 * rows), "hooks")
        while True:
            up = trees.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = trees.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
            jumped = scratch.table(_few(jumped, 2 * rows), "jump")
            moved = not jumped.filter("moved").isEmpty()
            scratch.drop(trees)
            trees = scratch.like(jumped.drop("moved"), jumped)
            if not moved:
                break
        if labels is None:
            labels = scratch.like(trees.select(F.col("a").alias("node"), F.col("p").alias("component")), trees)
        else:
            labels = relabelled(labels, trees.select(F.col("a").alias("node"), F.col("p").alias("component")), scratch)
        a, b = trees.select("a", F.col("p").alias("ra")), trees.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        roots = live.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        rest = scratch.table(_few(roots.filter(F.col("a") != F.col("b")).distinct(), rows), "edges")
        scratch.drop(live)
        live = rest
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))


def relabelled(labels: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """labels(node, component) after the components got components of their own in more."""
    step = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = scratch.table(_few(old, labels.count()), "labels")
    scratch.drop(labels)
    return out


def linked_components(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    *,
    sift: Callable[[DataFrame], DataFrame] | None = None,
    hubs: int = 1,
    most_pairs: int = 4,
) -> DataFrame:
    """buckets(bucket, id long) -> (node, component) by the pairs of a bucket that verify links.

    A column ``weight`` says which member is the first hub: the one with the least, then the least id.

    Two members of a bucket that no link joins yet are still to be compared; members of one
    component need no comparison, since only components are asked for. So a bucket of a
    thousand near copies costs a thousand comparisons with its hub, not half a million. A round
    compares each bucket's hub with the members outside the hub's component. After ``hubs``
    rounds all that is left is compared, which leaves no pair out: by ``sift``, which maps
    rows(bucket, id, c, n), c the component and n the bucket's size, to the links between different
    components in a bucket. Without it the pairs are joined, once they number at
    most ``most_pairs`` times the rows (or 200 thousand); until then the rounds go on with other hubs.
    ``verify`` maps pairs(a, b), a < b, to those that are links.
    """
    if "weight" not in buckets.columns:
        buckets = buckets.withColumn("weight", F.lit(0))
    live = scratch.table(buckets, "buckets")
    size = live.count()
    components = tested = None
    k = 0
    while True:
        # What is left of each bucket: members with their component, where there are two.
        if components is None:
            placed = live.select("bucket", "id", "weight", F.col("id").alias("c"))
        else:
            known = components.select(F.col("node").alias("id"), "component")
            placed = live.join(known, "id", "left").select("bucket", "id", "weight", F.coalesce("component", "id").alias("c"))
        order = F.struct("weight", "id") if k == 0 else F.xxhash64("id", F.lit(k))
        hub = F.min(F.struct(order.alias("o"), "id", "c")).alias("hub")
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), hub, F.count("*").alias("n")).filter("low < high")
        mixed = mixed.select("bucket", "n", F.col("hub.id").alias("hub"), F.col("hub.c").alias("hub_c"))
        placed = scratch.table(_few(placed.join(mixed, "bucket"), size), "placed")
        rows = placed.count()
        if not rows:
            break
        finish = k >= hubs
        if finish and sift is None:
            by = placed.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.max("n").alias("n"))
            left = by.agg(F.sum(F.col("m") * (F.col("n") - F.col("m")) / 2)).first()[0]
            finish = left <= max(most_pairs * size, 200_000)
        if finish and sift is not None:
            pairs = sift(placed.select("bucket", "id", "c", "n")).distinct()
        elif finish:
            x, y = (placed.select("bucket", F.col("id").alias(v), F.col("c").alias(f"c{v}")) for v in "ab")
            pairs = x.join(y, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
        else:
            pairs = placed.filter(F.col("c") != F.col("hub_c")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(_few(pairs, 2 * rows), "pairs")
        if not pairs.isEmpty():
            links = pairs if finish and sift is not None else verify(pairs)
            if components is None:
                components = connected_components(links, scratch)
            else:
                for x in "ab":
                    known = components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
                    links = links.join(known, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
                links = scratch.table(_few(links.select("a", "b", "ca", "cb"), size), "links")
                merged = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
                ends = [links.select(F.col(x).alias("node"), F.col(f"c{x}").alias("component")) for x in "ab"]
                every = components.unionByName(ends[0]).unionByName(ends[1]).distinct()
                components = relabelled(every, merged, scratch)
            tested = pairs if tested is None else tested.unionByName(pairs)
        if finish:
            break
        scratch.drop(live)
        live = scratch.like(placed.select("bucket", "id", "weight"), placed)
        k += 1
    if components is None:
        components = live.select(F.col("bucket").alias("node"), F.col("id").alias("component")).limit(0)
    return components
