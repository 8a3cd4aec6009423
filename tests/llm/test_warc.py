import hashlib
import random

import pytest

from refrain.llm import warc


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices([bytes([97 + i]) for i in range(9)], k=rng.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def brute(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        if len(p) >= 100 and page_id is not None:
            first[p] = min(page_id, first.get(p, page_id))
    out = []
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        f = first.get(p)
        visit = f is not None and page_id != f
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if visit else "response", f if visit else None))
    return sorted(out, key=repr)


def test_round_trip_of_odd_rows(spark):
    same, rng = "é" * 60, random.Random(1)
    rows = [
        (5, "http://a.example.com/x?q=1#f", same, 1), (3, "http://a.example.com/x", same, 2), (9, None, same, 3), (None, "http://[bad", same, 4),
        (1, "", None, 5), (2, "a\tb\nc", "", 6), (4, "http://B.example.com", "s" * 99, 7), (6, "http://b.example.com", "s" * 99, 8),
        (7, "u", "\r\n\r\nContent-Length: 5\r\n\r\n" * 9, 9), (7, "u", "\r\n\r\nContent-Length: 5\r\n\r\n" * 9, 9), (-8, "u", "z" * 300_000, 9),
    ]
    rows += [(100 + i, f"http://h{i % 3}.example.com/{rng.random()}", rng.choice([same, f"page {i} " * 20]), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(7)
    index, folder = warc.archive(df, fan_in=3)
    got = warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    lines = [(r["url_key"], r["captured"]) for r in index.orderBy("range", "place").collect()]
    assert len(lines) == len(rows)
    assert [x[0].encode() for x in lines] == sorted(x[0].encode() for x in lines)
    assert all(a[1] <= b[1] for a, b in zip(lines, lines[1:], strict=False) if a[0] == b[0])


def test_ranges_cut_the_merge(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 40)
    rows = [(i, f"http://one.example.com/{i % 5}", f"{i}" * 50) for i in range(500)]
    index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert index.select("range").distinct().count() > 5
    order = [(r["url_key"], r["captured"]) for r in index.orderBy("range", "place").collect()]
    assert order == sorted(order) and len(order) == 500


def test_empty_table(spark):
    index, folder = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(index, folder).count() == 0


def test_broken_record_is_refused():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(raw)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"pAyload"))
