import hashlib
import random
import re

from pyspark.sql import functions as F

from refrain.llm.pii import BASE, MORE, find, listed

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])]


def run(spark, rows):
    df = find(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    return {r["doc_id"]: r for r in df.select("doc_id", listed(BASE).alias("base"), listed(BASE + MORE).alias("all"), *[k.name for k in BASE + MORE]).collect()}


TEXTS = [
    None,
    "",
    "a.b+c@x-y.example.com_d@e.fr a@b a@b. @c.d x@y.z.",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3 01.02.03.04.",
    "4444333322221111 4444-3333 2222-1111 4444333322221112 44443333222211110000 4111 1111 1111 1111 1111",
    "+1 (303) 555-0142 +12 +1234567 ++441632960961 +1 234 567 890 123 4567 8 call +33 1 23 45 67 89.",
    "é😀 ñ 😀a@b.co 😀+1 (303) 555-0142\n😀1.1.1.1",
    "9" * 30_000,
    "a" * 30_000 + "@",
    "a@" + "b." * 8_000 + "c",
    "1.2.3.4 " * 2_000,
    "1 " * 9_000,
]


def test_base_spans_equal_brute_force(spark):
    got = run(spark, [(i, t, "x") for i, t in enumerate(TEXTS)])
    for i, t in enumerate(TEXTS):
        assert got[i]["base"] == ",".join(brute(t or "")), i


def test_checksums_and_context_add_spans(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    got = run(spark, [(1, f"pay to {iban} now", ""), (2, iban.replace("82", "83"), ""), (3, "my SSN: 123-45-6789", ""), (4, "part 123-45-6789", "")])
    assert got[1]["all"] == f"iban:7:{7 + len(iban)}"
    assert got[2]["all"] == ""
    assert got[3]["all"] == "ssn:8:19"
    assert got[4]["all"] == ""


def brute_more(text):
    """iban and ssn spans: leftmost matches, checksum, and words within 48 characters that no other match of the kind cuts off."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        flat = m[0].replace(" ", "")
        if 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
            out.append(f"iban:{m.start()}:{m.end()}")
    found = list(re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text))
    for m, after in zip(found, [*found[1:], None], strict=False):
        near = text[max(0, m.start() - 48) : m.start()] + "\n" + text[m.end() : min(m.end() + 48, after.start() if after else len(text))]
        if not re.match(r"000|666|9", m[0]) and "-00-" not in m[0] and not m[0].endswith("-0000") and re.search(r"\bssn\b|social security", near.lower()):
            out.append(f"ssn:{m.start()}:{m.end()}")
    return out


def test_more_spans_equal_brute_force(spark):
    rng = random.Random(9)

    def account():
        body = "".join(rng.choices("ABCDEFGH0123456789", k=rng.randint(11, 26)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        flat = f"GB{check if rng.random() < 0.7 else rng.randint(10, 99):02d}{body}"
        return flat if rng.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    piece = [account, lambda: f"{rng.choice(['123', '000', '666', '900', '078'])}-{rng.choice(['45', '00'])}-{rng.choice(['6789', '0000'])}", lambda: rng.choice(["ssn", "SSN:", "my social security", "word " * 12, "é😀", "\n", "-", "x"])]
    rows = [(i, " ".join(rng.choice(piece)() for _ in range(rng.randint(0, 14))), "") for i in range(300)]
    got = run(spark, rows)
    hits = 0
    for i, text, _ in rows:
        own = [x for x in got[i]["all"].split(",") if x.startswith(("iban", "ssn"))]
        assert own == brute_more(text), text
        hits += len(own)
    assert hits > 200


def test_sql_of_the_query_equals_it_on_odd_texts(spark, tmp_path):
    import duckdb
    import pandas as pd

    from refrain.llm.oracle import OP8
    from refrain.llm.pii import op8_pii_spans

    rng = random.Random(4)
    iban = "GB82 WEST 1234 5698 7654 32"
    odd = [
        f"pay {iban} now", f"_{iban.replace(' ', '')}_ x{iban}", f"account: {iban} {iban}", "ssn 123-45-6789", "-123-45-6789 ssn", "ssn 123-45-6789-", "é😀 my social security: 123-45-6789 078-05-1120",
        "mail" + "x" * 44 + " a@b.co 1.1.1.1 host", "host 1.1.1.1" + " " * 60 + "2.2.2.2", "visa 4444333322221111\ncard", "call +44 20 7946 0958, fax", "ssn_123-45-6789", "000255.0.0.1 ip",
    ]
    pieces = [iban, iban.replace(" ", ""), "123-45-6789", "ssn", "a@b.co", "1.2.3.4", "4444333322221111", "+1 (303) 555-0142", "card", "_", "-", "é😀", "\n", " ", "  ", "mail", "word " * 9]
    odd += ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    texts = [t for t in TEXTS if not t or len(t) < 20_000] + odd
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = op8_pii_spans(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = con.execute(OP8)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = {r[0]: r for r in found.fetchall()}
    for r in got.select(*columns).collect():
        assert tuple(r) == want.pop(r["doc_id"]), texts[r["doc_id"]]
    assert not want


def test_context_on_both_sides_and_over_other_matches(spark):
    far = " x" * 40
    rows = [(1, "123-45-6789 is my social security number", ""), (2, f"123-45-6789{far} ssn", ""), (3, "ssn 111-22-3333 and 123-45-6789", ""), (4, f"ssn{far} 123-45-6789", "")]
    got = run(spark, rows)
    assert [got[i]["all"] for i in (1, 2, 3, 4)] == ["ssn:0:11", "", "ssn:4:15,ssn:20:31", ""]


def test_context_moves_the_score_only(spark):
    got = run(spark, [(1, "visa card 4444333322221111", ""), (2, "number 4444333322221111", "")])
    assert got[1]["card"][0]["score"] > got[2]["card"][0]["score"]


def test_query_over_small_table(spark):
    from refrain.llm.pii import op8_pii_spans

    d = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op8_pii_spans(spark, d).collect()
    assert len(rows) == len(text)
    for r in rows:
        found = brute(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(f.startswith(k + ":") for f in found) for k in PATTERNS]


def test_empty_table(spark):
    assert find(spark.createDataFrame([], "doc_id long, text string")).agg(F.count("*")).first()[0] == 0
