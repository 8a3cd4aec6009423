import re
from collections import Counter

import corpus_pipeline
import test_line_dedup
import test_near_dedup
import test_quality

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    (_, quality), (_, lines), (_, near), (_, mixing), (_, packing) = corpus_pipeline.STAGES
    good = quality(spark, docs, D).cache()
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    for r in docs.collect():
        n, *_, repeat = test_quality.brute(r["text"])
        if r["doc_id"] in kept:
            assert n >= 10 and 100 * repeat <= 20 * n
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert sum((d in kept) == (q == 1) for d, q in label.items()) / len(label) > 0.93

    deduped = lines(spark, good, D).cache()
    expected = test_line_dedup.brute(list(kept.items()))
    got = {r["doc_id"]: r["text"] for r in deduped.collect()}
    assert got == {d: t for d, t in expected.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())

    one = near(spark, deduped, D).cache()
    components = test_near_dedup.brute(sorted(got.items()))
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in components.items() if c == d}

    mixed = mixing(spark, one, D).cache()
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert abs(words(mixed.collect()) / words(one.collect()) - 1.5) < 0.15

    packed = packing(spark, mixed, D).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, gone string, copies int, component_id string, size int, at int, rank int, id int"
GOOD = [" ".join(f"{w}{k}" for w in ("river", "stone", "Cloud", "meadow", "lantern", "harbor", "winter.", "copper", "garden", "mirror")) for k in range(40)]


def odd_docs(spark):
    more = (True, "g", 1, "c", 2, 3, 4, 5)
    rows = [
        (None, None, None, None, None), (None, GOOD[0], "en", "a", 1), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, " ".join(GOOD) * 200, "en", None, 9),
        (5, GOOD[1] + "\n" + GOOD[2], "en", "a", 9), (5, GOOD[1] + "\n" + GOOD[2], "en", "a", 9), (5, GOOD[3], "en", "b", 9), (6, GOOD[1] + "!", "en", "b", 9), (7, GOOD[4], None, "b", None),
        (8, GOOD[5] + "\n" + GOOD[5], "en", "b", 9), (9, "short", "en", "b", 5),
    ]
    return spark.createDataFrame([r + more for r in rows], SCHEMA).repartition(3)


def test_every_stage_takes_odd_rows(spark):
    (_, quality), (_, lines), (_, near), (_, mixing), (_, packing) = corpus_pipeline.STAGES
    docs = odd_docs(spark)
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for stage in (quality, lines, near, mixing):
        assert tuple(stage(spark, docs, D).columns) == corpus_pipeline.COLUMNS

    judged = key(quality(spark, docs, D))
    assert not {(None, None), (1, None), (2, ""), (9, "short")} & set(judged)
    assert judged.count((5, GOOD[1] + "\n" + GOOD[2])) in (0, 2)

    split = key(lines(spark, docs, D))
    assert {(None, None), (None, GOOD[0]), (1, None), (2, ""), (3, " \n\t")} <= set(split)
    assert split.count((5, GOOD[1] + "\n" + GOOD[2])) == 2 and (5, GOOD[3]) in split and (8, GOOD[5]) in split
    assert 6 not in {d for d, _ in split}  # its one line is like the first of document 5

    one = key(near(spark, docs, D))
    assert {(None, None), (None, GOOD[0]), (1, None), (2, ""), (3, " \n\t")} <= set(one) and len([d for d, _ in one if d == 5]) == 3

    mixed = key(mixing(spark, docs, D))
    assert not {(None, None), (1, None), (2, ""), (3, " \n\t")} & set(mixed)
    assert mixed == key(mixing(spark, docs.repartition(1), D))

    packed = packing(spark, docs, D).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert max(r["piece"] for r in packed if r["doc_id"] == 4) > 0


def test_every_stage_takes_an_empty_table(spark):
    empty = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0
