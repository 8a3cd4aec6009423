import random
import re

import numpy as np
import pytest

from refrain.llm.line_dedup import band_keys, dedup_lines, removed_lines, shingles
from refrain.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(line):
    """Every run of eight characters; a shorter line is one."""
    low = line.lower()
    return {low[i:j] for i in range(len(low)) for j in [i + 8] if j <= len(low)} or {low}


def brute(rows, percent=75):
    """doc_id -> lines that stay, for unique doc_ids: every two lines are compared."""
    lines = [(d, n, x) for d, t, *_ in sorted(rows) for n, x in enumerate(t.split("\n")) if WORD.search(x)]
    sets = [grams(x) for _, _, x in lines]
    near = {i: {j for j in range(len(lines)) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) or lines[i][2] == lines[j][2]} for i in range(len(lines))}
    seen, gone = set(), set()
    for i in range(len(lines)):  # the first of a component is met first
        todo = [] if i in seen else [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += near[j]
                if j != i:
                    gone.add(lines[j][:2])
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t, *_ in rows}


def texts(spark, rows):
    got = dedup_lines(spark.createDataFrame([(d, t, "s", "g") for d, t in rows], "doc_id long, text string, source string, gone string").repartition(6))
    return {r["doc_id"]: r["text"] for r in got.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    base = [" ".join(rng.choices(words, k=n)) for n in (1, 3, 5, 9, 12, 20, 31, 45, 80, 200, 500) for _ in range(4)]

    def near(line):
        w = line.split(" ")
        for _ in range(len(w) // 60 + (len(w) > 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = []
    for d in range(60):
        own = [rng.choice([rng.choice(base), near(rng.choice(base)), rng.choice(base) + "!", " ".join(rng.choices(words, k=25)), "Short line.", "", "  \t "]) for _ in range(rng.randint(1, 8))]
        rows.append((d, "\n".join(own)))
    assert texts(spark, rows) == brute(rows)


@pytest.mark.parametrize(
    "a,b,linked",
    [
        (" ".join(f"prefixed{x}one" for x in "abcdefghij"), " ".join(f"prefixed{x}two" for x in "klmnopqrst"), False),  # words agree in eight characters
        ("Subscribe to our weekly newsletter today", "Subscribe to our weekly newsletter today!", True),
        ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0", True),
        ("x1y2z3" * 16, "x1y2z3" * 16 + ".", True),
        ("".join(chr(0x4E00 + i * 7) for i in range(60)), "".join(chr(0x4E00 + i * 7) for i in range(59)), True),  # no blanks
        ("abcdefg", "abcdefg!", False),
        ("https://example.org/" + "a1b2c3d4" * 9, "https://example.org/" + "e5f6a7b8" * 9, False),
    ],
)
def test_whole_lines_are_compared(spark, a, b, linked):
    rows = [(1, a), (2, b)]
    assert brute(rows)[2] == ("" if linked else b)
    assert texts(spark, rows) == brute(rows)


def test_shingles_are_those_of_every_position():
    lines = ["a", "abcdefgh", "abcdefghi", "é" * 7 + "xyz", "𝒳 y" * 30, *("".join(random.Random(n).choices("abcdefgh 𝒳é", k=n)) for n in range(9, 80))]
    h, starts = shingles(lines)
    seen = {}
    for line, own in zip(lines, np.split(h, starts[1:]), strict=True):
        low = line.lower()
        expected = [low[i : i + 8] for i in range(max(1, len(low) - 7))]
        assert len(own) == len(expected)
        for x, y in zip(own, expected, strict=True):
            assert seen.setdefault(y, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [12, 60, 110, 400])
def test_recall_of_the_bands_at_the_threshold(n):
    """Lines of n shingles of which a quarter is lost at the end: a similarity of 0.75 and a bit."""
    rng = random.Random(n)
    pairs = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n + 7))] * 2 for _ in range(2000)]
    keys = [band_keys([x[side][: None if side else n + 7 - n // 4] for x in pairs]) for side in (0, 1)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.975


def test_a_band_of_many_blocks(spark):
    """Equal bands, blocks of four lines: chains are joined across blocks."""
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    rows = [(i, base[: 300 - 6 * (i % 12)] + "".join(rng.choices("XYZW", k=i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in removed_lines(df, Scratch(spark, "t"), block=4).collect()}
    assert gone == {d for d, t in brute(rows).items() if not t}


def test_odd_rows(spark):
    long = "x" * 50_000 + " y" * 9
    rows = [(None, "a\na"), (1, None), (2, ""), (3, "\n\n"), (4, "b\nc\r\nb"), (4, "b\nd"), (5, long), (6, long), (7, "c"), (7, "c"), (8, "c\r")]
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert (None, "a\na") in got and (1, None) in got and (2, "") in got and (3, "\n\n") in got
    assert sorted(t for d, t in got if d == 4) == ["b\nc\r", "d"] or sorted(t for d, t in got if d == 4) == ["b\nd", "c\r"]
    assert [t for d, t in got if d == 5] == [long] and [t for d, t in got if d == 6] == [""]
    assert [t for d, t in got if d == 7] == ["c", "c"]
    assert [t for d, t in got if d == 8] == [""]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_executors(spark, monkeypatch):
    plans, table = [], Scratch.table

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", noted)
    base = "one line of a few words that is often met"
    df = spark.createDataFrame([(i, f"{base}\n{base}{'!' * (i % 3)}\n{i}") for i in range(9)], "doc_id long, text string")
    out = dedup_lines(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5
    assert not [p for p in plans if re.search("MapIn|Python|Pandas|ArrowEval", p)]


@pytest.mark.parametrize("many", [0, 1000])
def test_pairs_of_a_block_as_rows_or_in_its_row(spark, monkeypatch, many):
    monkeypatch.setattr("refrain.llm.line_dedup.MANY", many)
    monkeypatch.setattr("refrain.llm.line_dedup.HUBS", 0)
    rng = random.Random(7)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    rows = [(i, base[: 300 - 9 * (i % 20)] + "".join(rng.choices("XYZW", k=i % 7))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in removed_lines(df, Scratch(spark, "t"), block=6).collect()}
    assert gone == {d for d, t in brute(rows).items() if not t}


def test_unlike_lines_of_a_band_are_not_compared_in_full(spark, monkeypatch):
    """Lines that share a sixth of their shingles often share a band; their signatures tell them apart, also in blocks."""
    from refrain.llm import line_dedup

    confirmed, met = line_dedup.confirmed, []

    def noted(pairs, texts, percent):
        met.append(pairs.count())
        return confirmed(pairs, texts, percent)

    monkeypatch.setattr(line_dedup, "confirmed", noted)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choices(letters, k=100))
    rows = [(i, base + "".join(rng.choices(letters, k=250))) for i in range(300)]
    rows += [(1000 + i, t + "!") for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in removed_lines(df, Scratch(spark, "t"), block=40).collect()}
    assert gone == set(range(1000, 1005))
    assert sum(met) < 5000


def test_signatures_sift_pairs(spark):
    """Pairs of unlike lines go before texts are read; those at the threshold and short ones stay."""
    from refrain.llm.line_dedup import sifted, signed

    rng = random.Random(4)
    a = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(60)]
    near = [x[: 300 - 293 // 4] for x in a]
    lines = a + near + ["short line", "other one"]
    signs = signed(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    pairs = [(i, 60 + i) for i in range(60)] + [(i, i + 1) for i in range(59)] + [(120, 121)]
    got = {(r["a"], r["b"]) for r in sifted(spark.createDataFrame(pairs, "a long, b long"), signs, 75).collect()}
    assert got == {(i, 60 + i) for i in range(60)} | {(120, 121)}
