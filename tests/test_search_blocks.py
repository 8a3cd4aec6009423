import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.operators import search
from refrain.plans.fixtures import vectors


@pytest.fixture
def small(monkeypatch):
    """Sizes at which a table of 500 vectors is too large to be sent to every task."""

    def shrink():
        monkeypatch.setattr(search, "EXACT_LIMIT", 100)
        monkeypatch.setattr(search, "BLOCK", 90)

    return shrink


def test_pairs_in_blocks_equal_pairs_at_once(spark, small):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    odd = spark.createDataFrame([(9001, [0.0] * 64), (9002, [1.0, 2.0]), (9003, [2.0, 4.1])], "id long, v array<float>")
    rows = rows.unionByName(odd)
    want = sorted(map(tuple, search.similar_pairs(rows, 0.3).collect()))
    small()
    got = sorted(map(tuple, search.similar_pairs(rows, 0.3).collect()))
    assert want and got == want and any(p[:2] == (9002, 9003) for p in got)


def test_top_k_in_blocks_equals_top_k_at_once(spark, small):
    v = vectors(spark, "/root/testdata/sf0.01")
    kept = search.stored(v, F.col("source_id").cast("long"))
    order = ["source_id", "rank"]
    one = search.exact_top_k(v, kept, 5, 0.2)
    want = one.orderBy(*order).collect()
    small()
    more = search.exact_top_k(v, kept, 5, 0.2)
    assert more.columns == one.columns
    assert np.array_equal([tuple(r) for r in want], [tuple(r) for r in more.orderBy(*order).collect()])
