import random
import re

import numpy as np

from refrain.llm import near_dedup
from refrain.llm.near_dedup import least_matches, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    low = {d: d for d, _ in rows}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def fixture(n=160, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.choice([3, 8, 40, 120, 400])) for _ in range(20)]
    rows = []
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(words).upper()
        rows.append((d * 7 - 300, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (None, "a b c d e f", 1), (None, None, 1), (4, "A b", 1), (5, "a B", 1), (6, "a b", 1), (7, long, 1), (8, long + " end", 1), (8, long + " end", 1), (9, "É b", 1), (10, "é b", 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bucket int")).collect()
    assert len(got) == len(rows)
    component = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert component == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_a_large_bucket(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 60000, (3, 32)).astype(np.uint16)
    sets = [np.sort(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(3)]
    data = []
    for i in range(90):
        s = base[i % 3].copy()
        s[rng.integers(0, 32, 2)] = 7
        own = sets[i % 3][: 60 if i % 6 >= 3 else 100]  # 60 of 100 is too little
        data += [(b, i, i, 90, bytearray(s.tobytes()), [1, 2], bytearray(own.tobytes())) for b in (1, 2)]
    df = spark.createDataFrame(data, "bucket long, id long, c long, n long, sig binary, bands array<long>, hashes binary")
    one = df.filter("bucket = 1")
    sketches, full = one.select(near_dedup.F.col("id").alias("doc_id"), "sig", "bands"), one.select("id", "hashes")
    for block in (16, 1024):
        got = [(r["a"], r["b"]) for r in near_dedup.sifted(df.select("bucket", "id", "c", "n"), sketches, full, 75, 1e-6, 16, 32, block).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 6 == b % 6}


def test_bounds_spare_pairs_at_the_threshold():
    least = least_matches(0.75, 1e-6, [32, 288])
    rng = np.random.default_rng(0)
    assert (rng.binomial(288, 0.75, 100_000) >= least[288]).mean() > 0.9999
    assert (rng.binomial(32, 0.2, 10_000) < least[32]).mean() > 0.5
