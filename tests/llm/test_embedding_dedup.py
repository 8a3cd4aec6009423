import numpy as np
import pytest

from refrain.llm.embedding_dedup import embedding_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, cell int"


def brute(rows, threshold):
    good = [
        (i, np.array(v, float), label)
        for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
    ]
    links = {k: [] for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            x, y = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.sqrt((x[1] @ x[1]) * (y[1] @ y[1])) >= threshold:
                links[a].append(b)
                links[b].append(a)
    part = list(range(len(good)))
    moved = True
    while moved:
        moved = False
        for a, bs in links.items():
            for b in bs:
                low = min(part[a], part[b], key=lambda k: good[k][0])
                moved |= part[a] != low or part[b] != low
                part[a] = part[b] = low
    known = {}
    for k, (i, *_) in enumerate(good):
        known.setdefault(i, []).append((len(links[k]), good[part[k]][0]))
    return known


@pytest.mark.parametrize("cell", [20, 1000])
def test_equals_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        c = centres[rng.integers(12)]
        v = c + rng.normal(size=16) * rng.choice([0.02, 0.13, 0.18, 1.0])
        rows.append((1000 - i, [float(np.float32(x)) for x in v * rng.choice([0.5, 1, 3])], int(rng.integers(2)), 0))
    rows += [(2000 + i, rows[0][1], rows[0][2], 0) for i in range(30)]
    rows += [(3000, None, 1, 0), (3001, [0.0] * 16, 1, 0), (3002, [float("nan")] + [1.0] * 15, 1, 0), (3003, [None] + [1.0] * 15, 1, 0), (3004, [float("inf")] * 16, 1, 0)]
    rows += [(3005, rows[0][1], None, 0), (3006, rows[0][1], 7, 0), (3007, [1.0, 2.0], 1, 0), (3008, [1.0, 2.0], 1, 0), (3009, [], 1, 0)]
    expected = brute(rows, 0.98)
    got = embedding_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), cell=cell, block=32).collect()
    assert len(got) == len(rows)
    own = {}
    for r in got:
        own.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert {i: sorted(x) for i, x in own.items()} == {i: sorted(expected.get(i, [(0, i)])) for i in own}


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0], 1, 0), (5, [0.0, 1.0], 1, 0), (7, [1.0, 0.01], 1, 0), (9, [1.0, 0.02], 1, 0), (3, [0.0, 2.0], 1, 0), (3, [0.0, 2.0], 2, 0), (4, None, 1, 0), (4, [1.0, 0.0], 1, 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(3, 0, 3), (3, 1, 3), (4, 0, 4), (4, 3, 4), (5, 1, 3), (5, 3, 4), (7, 3, 4), (9, 3, 4)]


def test_a_cell_of_many_blocks_and_one_cosine(spark):
    """Vectors around one direction, half of them at one cosine to it."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        turn = rng.normal(size=6)
        turn /= np.linalg.norm(turn)
        rows.append((i, [float(x) for x in np.float32([1.0, *(turn * (0.12 if i % 2 else rng.uniform(0, 0.4)))])], 1, 0))
    expected = brute(rows, 0.98)
    for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA), cell=10_000, block=9).collect():
        assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]][0]


def test_empty_and_unusable_tables(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_duplicates(spark.createDataFrame([(None, [1.0], 1, 0), (4, None, 1, 0), (4, None, 1, 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in got) == [(-1, 0, True), (4, 0, True), (4, 0, True)]
