import re

import pytest
import regex
from pyspark.sql import functions as F

from refrain.llm.secrets import FEATURES, candidates, features, fit_forest, fit_model, labelled_findings, op10_secret_scan, scan, training_table, trees_of, vote


@pytest.fixture(scope="module")
def trees(spark):
    return fit_forest(labelled_findings(spark))


def test_held_out_accuracy(spark, trees):
    held = labelled_findings(spark, 2500, 1_000_000)
    seen = held.select("secret", F.struct(*[v.alias(k) for k, v in features(F.col("match"), F.col("before"), F.col("path")).items()]).alias("x"))
    rows = seen.select("secret", vote(trees, F.col("x")).alias("score")).collect()
    right = sum((r["score"] > 0.5) == (r["secret"] == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert set(FEATURES) == set(features(F.lit("a"), F.lit("b"), F.lit("c")))


def test_accuracy_on_forms_that_were_not_fitted(spark):
    """Each quarter of the forms is judged by a forest that saw the other three only."""
    right = every = 0
    for k in range(4):
        own = fit_forest(labelled_findings(spark, part=tuple({0, 1, 2, 3} - {k})))
        held = training_table(labelled_findings(spark, 600, 2_000_000, part=(k,)))
        rows = held.select("secret", vote(own, F.struct(*FEATURES)).alias("score")).collect()
        right += sum((r["score"] > 0.5) == (r["secret"] == 1) for r in rows)
        every += len(rows)
    print(f"accuracy on unseen forms: {right / every:.3f}")
    assert right / every > 0.75


def test_the_expression_votes_as_the_model_does(spark):
    model = fit_model(labelled_findings(spark, 1200), trees=9)
    rows = training_table(labelled_findings(spark, 700, 3_000_000))
    both = rows.select("*", vote(trees_of(model.toDebugString), F.struct(*FEATURES)).alias("score"))
    for n, tree in enumerate(model.trees):
        both = tree.setPredictionCol(f"p{n}").setRawPredictionCol(f"r{n}").setProbabilityCol(f"q{n}").transform(both)
    for r in both.collect():
        assert abs(r["score"] - sum(r[f"p{n}"] for n in range(9)) / 9) < 1e-12


def test_finds_planted_secrets_and_no_prose(spark, trees):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f'é😀 thing token = "{key}" more', "src1"), (2, f'!! TOKEN = "{key.upper()}"!!', "src1"), (3, "donaudampfschifffahrtsgesellschaft est 4644348398010899", None),
        (4, None, "a"), (5, "", "a"), (6, f"commit {key}", "src1"), (7, "x" * 50_000, "src1"), (7, "x" * 50_000, "src1"), (8, f'token = "{key}"', "tests/fixtures/a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("found", F.lit(1))
    got = [(r["doc_id"], r["n_candidates"], [(s["start"], s["end"]) for s in r["secrets"]]) for r in scan(df, trees).collect()]
    assert (1, 1, [(18, 58)]) in got
    assert (2, 1, [(12, 52)]) in got
    assert sorted(g for g in got if g[0] > 2) == [(3, 2, []), (4, 0, []), (5, 0, []), (6, 1, []), (7, 1, []), (7, 1, []), (8, 1, [])]


def test_query_finds_every_planted_token(spark):
    d = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    planted = re.compile(r'token = "([0-9a-f]{40})"', re.I)
    pattern = regex.compile(r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![\p{L}\p{N}])")
    rows = op10_secret_scan(spark, d).collect()
    assert len(rows) == len(text)
    extra = 0
    for r in rows:
        t = text[r["doc_id"]]
        assert r["n_candidates"] == len(pattern.findall(t))
        found = set(filter(None, r["spans"].split(",")))
        want = {f"{m.start(1)}:{m.end(1)}" for m in planted.finditer(t)}
        assert want <= found
        extra += len(found - want)
    assert extra <= 1


KEY_VALUE = [
    ("API_TOKEN={}", "ghp_EhtHdKdZkkopKcSkEvtuMbmqp0ZGaEDvzEp2"),
    ("see https://example.org/a?access_token={}&x", "abcdef0123456789abcdef0123456789"),
    ("\naws_secret_access_key={}\n", "wJalrXUtnFEMIq7MDENGbPxRfiCYzT4kLk9Qe2Za"),
    ("Server=db;User=app;Password={};Pooling=true", "k9Zq2Lw8Xr5Tb1Vn7Ym4"),
    ("client_secret_value_of_app={}", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZg=="),
]


def test_finds_values_straight_after_a_key(spark, trees):
    rows = [(i, form.format(value), "src1") for i, (form, value) in enumerate(KEY_VALUE)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"]] for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), trees).collect()}
    for i, (form, value) in enumerate(KEY_VALUE):
        at = form.index("{}")
        assert (i, got[i]) == (i, [(at, at + len(value))])


def test_proposes_keys_and_values_apart(spark):
    text = "API_TOKEN=ghp_abcdefghijklmnopqrstuvwx0123456789 a_key_of_twenty_or_so=Zm9vYmFyYmF6cXV4MTIz== Zm9vYmFyYmF6cXV4MTIz===x"
    found = spark.createDataFrame([(text,)], "text string").select(candidates(F.col("text")).alias("c")).first()["c"]
    assert [c["match"] for c in found] == ["ghp_abcdefghijklmnopqrstuvwx0123456789", "a_key_of_twenty_or_so", "Zm9vYmFyYmF6cXV4MTIz==", "Zm9vYmFyYmF6cXV4MTIz=="]
    assert all(text[c["start"] : c["end"]] == c["match"] for c in found)


def test_before_reaches_over_the_previous_candidate(spark):
    text = 'é😀 ' * 20 + 'aws_secret_access_key = "wJalrXUtnFEMIq7MDENGbPxRfiCYzT4kLk9Qe2Za" and next_page_of_orders'
    found = spark.createDataFrame([(text,)], "text string").select(candidates(F.col("text")).alias("c")).first()["c"]
    assert len(found) == 3
    assert [c["before"] for c in found] == [text[: c["start"]][-40:] for c in found]
    assert 'aws_secret_access_key = "' in found[1]["before"]


def test_empty_table(spark, trees):
    assert scan(spark.createDataFrame([], "doc_id long, text string, source string"), trees).count() == 0
