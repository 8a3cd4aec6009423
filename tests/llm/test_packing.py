import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from refrain.llm.packing import best_fit, pack, sweep, tokenizer_path

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute(sizes, length):
    """Sequences of best fit, the largest first, a piece at a time."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        k = bisect_left(gaps, size)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else length) - size)
    return len(gaps)


def filled(sequence, offset, sizes, length):
    rows: dict[int, list] = {}
    for q, o, n in zip(sequence, offset, sizes, strict=True):
        rows.setdefault(q, []).append((o, n))
    for own in rows.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    return len(rows)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_need_no_more_sequences_than_best_fit(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 50, 300])
    low, high = rng.choice([(1, length), (1, length // 5 + 1), (length // 4, length // 2), (length, length)])
    sizes = np.array([rng.randint(low, high) for _ in range(rng.randint(1, 3000))])
    n = filled(*best_fit(sizes, length), sizes, length)
    assert -(-sizes.sum() // length) <= n <= 1.02 * brute(sizes.tolist(), length) + 1


def test_documents_of_the_test_table_fill_their_sequences():
    """Sizes like those of documents leave nothing over."""
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(6, 1.3, 20_000).astype(int), 1, 4096)
    assert filled(*best_fit(sizes, 4096), sizes, 4096) <= brute(sizes.tolist(), 4096) + 1


@pytest.mark.parametrize("seed", range(6))
def test_sweep_matches_as_brackets(seed):
    """Gaps in ascending order, each takes the largest piece that fits and is free."""
    rng = np.random.default_rng(seed)
    pieces, gaps = rng.integers(1, 30, rng.integers(0, 60)), rng.integers(0, 30, rng.integers(0, 60))
    free, expected = sorted(pieces.tolist()), []
    for g in sorted(gaps.tolist()):
        fits = [x for x in free if x <= g]
        if fits:
            free.remove(fits[-1])
            expected.append((g, fits[-1]))
    got, gap = sweep(pieces, gaps)
    assert len(set(got)) == len(got) and len(set(gap)) == len(gap)
    assert sorted(zip(gaps[gap].tolist(), pieces[got].tolist(), strict=True)) == sorted(expected)


def test_stripes(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 60)) for i in range(600)], "doc_id long, text string")
    rows = pack(docs, FILE, length=64, stripe=100).collect()
    sizes = [r["length"] for r in rows]
    n = filled([r["sequence_id"] for r in rows], [r["offset"] for r in rows], sizes, 64)
    assert sorted(r["doc_id"] for r in rows) == list(range(600)) and n <= brute(sizes, 64) * 1.02 + 12


def test_pack_matches_the_tokenizer_and_leaves_no_holes(spark):
    texts = ["Hello, World! it's 42", None, "", "a" * 5000, "x y\n" * 3000, "Hello, World! it's 42", "É́ naïve <|endoftext|> ok\t tab", "one"]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "lost", "x"), (7, "one", "x")], "doc_id long, text string, sequence_id string")
    rows = [r.asDict() for r in pack(docs, FILE, length=64).collect()]
    encoder = Tokenizer.from_file(FILE)
    ids = {i: encoder.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for i, own in ids.items():
        got = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        if i == 7:
            assert len(got) == 2
            continue
        assert [r["start"] for r in got] == list(range(0, len(own), 64))
        for r in got:
            part = own[r["start"] : r["start"] + 64]
            assert r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= sum(len(x) for x in ids.values()) / 64 * 1.1 + 2


def test_pack_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_pack_rejects_bad_length(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), length=0)
