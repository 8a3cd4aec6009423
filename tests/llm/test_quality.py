import re
from collections import Counter

import numpy as np

from refrain.llm.boosting import fit
from refrain.llm.quality import COUNTS, STATISTICS, keep_good, labelled_sample, op3_quality_rules, quality, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")
D = "/root/testdata/sf0.01"


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    repeat = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)


def test_counts_equal_brute_force_and_held_out_accuracy(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = op3_quality_rules(spark, D).collect()
    assert len(rows) == len(text)
    for r in rows:
        own = brute(text[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == own
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r["base_failed"] and r["kept"])
    x = np.array([statistics(text[d] or "")[len(COUNTS) :] for d in label])
    y = np.array(list(label.values()), float)
    half = len(y) // 2
    model = fit(x[:half], y[:half], list(STATISTICS.values()))
    assert ((model.score(x[half:]) >= 0) == (y[half:] == 1)).mean() > 0.97


def test_query_scores_equal_a_walk_down_each_tree(spark):
    """The query's score and kept, from trees walked a node at a time."""
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    stats = {d: statistics(t or "")[len(COUNTS) :] for d, t in text.items()}
    rows = sorted((y, *stats[d]) for d, y in label.items() if d in stats and y in (0, 1))
    data = np.array(rows, float)
    model = fit(data[:, 1:], data[:, 0], list(STATISTICS.values()))

    def walk(x):
        total = model.bias
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return total

    for r in op3_quality_rules(spark, D).collect():
        score = walk(stats[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-9
        assert r["kept"] == (not r["base_failed"] and score >= 0)


def test_the_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 3 AS INT) AS quality").repartition(7)
    drawn = [sorted(r["doc_id"] for r in labelled_sample(labels, 300).collect()) for _ in range(2)]
    assert drawn[0] == drawn[1] and 200 < len(drawn[0]) < 420 and all(d % 3 < 2 for d in drawn[0])
    assert labelled_sample(labels, 10_000).count() == 3334


def test_odd_texts():
    for t in ("", "\n\n", "a\x1cb c d e", "a b c d e " * 50, "é# 😀$\n\té# 😀$", "x" * 100_000, "a b c d e f a b c d e"):
        assert statistics(t)[: len(COUNTS)] == brute(t)


def test_scores_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) * 0.7 > 0).astype(float)
    model = fit(x, y, [1, 0, -1], trees=30)
    probe = np.repeat(x[:50], 40, axis=0)
    for column, sign in ((0, 1), (2, -1)):
        grid = probe.copy()
        grid[:, column] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (np.diff(model.score(grid).reshape(50, 40), axis=1) * sign >= -1e-12).all()
    assert ((model.score(x) > 0) == (y == 1)).mean() > 0.8


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "word " * 3, 1), (1, None, 1), (2, " ".join(f"w{i}" for i in range(50)), 1), (2, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, None), (9, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 3, False), (1, 0, False), (2, 0, False), (2, 50, True)]
    assert [r["doc_id"] for r in keep_good(docs, labels).collect()] == [2]
    assert quality(docs.limit(0), labels).count() == 0
