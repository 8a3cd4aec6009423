import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from refrain.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """source -> (source_size, target)"""
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else level * weight[s]
            left -= target[s] if over else 0
        free -= over or set(free)
    return {s: (size[s], target[s]) for s in order}


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 90])), rng.choice(["a"] * 9 + ["b", "ß", "😀", "Z", None]), 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(7)
    got = mix(df).collect()
    assert len(got) == len(rows)
    expected, taken = brute(rows), {}
    for r in got:
        n, target = expected[r["source"]]
        assert r["source_size"] == n and abs(r["target"] - target) < 1e-6 * max(1, target)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, (_, target) in expected.items():
        assert abs(taken[s] - target) <= 90
    again = {(r["doc_id"], r["taken"]) for r in mix(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_the_draw_is_in_pareto_order(spark):
    """Against the method in plain Python: certain copies, a probability by size, random odds over its odds."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 2, 5, 9, 30, 200, 2000]) + f"x{i}", "abc"[i % 3]) for i in range(900)]
    got = {r["doc_id"]: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    expected, size = brute(rows), {d: len(t.split()) for d, t, _ in rows}
    by_u = by_rank = 0
    for s in "abc":
        own = [(d, t) for d, t, x in rows if x == s]
        n, target = expected[s]
        whole = int(target / n)
        rest = target - whole * n
        low, high = 0.0, 1.0
        for _ in range(200):  # the rate at which the expected words are the remaining ones
            rate = (low + high) / 2
            words = sum(min(1, rate * int(size[d] ** 0.5)) * size[d] for d, _ in own)
            low, high = (rate, high) if words < rest else (low, rate)
        order, by_hash = [], []
        for d, t in own:
            p = min(1, rate * int(size[d] ** 0.5))
            u = (int(hashlib.md5(f"17|{d}|{t}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
            order.append((-1 if p > 1 - 1e-9 else u / (1 - u) / (p / (1 - p)), d))
            by_hash.append((u, d))
        taken = {d for d, _ in own if got[d]["copies"] > whole}
        assert taken == {d for _, d in sorted(order)[: len(taken)]}
        assert all(got[d]["copies"] in (whole, whole + 1) for d, _ in own)
        assert abs(sum(size[d] for d in taken) - rest) <= 2001
        by_u += len(taken ^ {d for _, d in sorted(by_hash)[: len(taken)]})
        by_rank += len(taken)
    assert by_u > by_rank / 10  # the order by U alone is another one


def test_equal_rows_are_drawn_each(spark):
    rows = [(None, "w w w", "a")] * 500 + [(None, "w w w w", "a")] * 500 + [(7, "x " * 10, "b")] * 300 + [(9, "y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(df).collect()
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 10 for s in "abc"), (taken, target)
    count = lambda rows: Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert count(got) == count(mix(df.repartition(2)).collect())


def test_odd_tables(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) in (8, 9, 10, 12)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    assert mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).agg(F.sum("taken")).first()[0] == 0
