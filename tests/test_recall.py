import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.operators.search import exact_top_k, lsh_top_k, self_anchors, stored
from refrain.options import SearchOptions


def near_vectors(spark, noise, n=1500, dim=64):
    """Vectors in groups of three around a centre; noise sets their similarity."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // 3, dim))
    x = np.repeat(centres, 3, axis=0) + rng.normal(size=(n, dim)) * noise
    rows = [(f"s{i}", "", "", "recording", "e", "k", float(i), float(i + 1), i, i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    schema = "source_id string, source_name string, source_path string, source_type string, extractor_id string, kind string, start_s double, end_s double, start_byte long, end_byte long, values array<float>"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("noise,threshold,least", [(0.08, 0.985, 0.99), (0.18, 0.95, 0.95), (0.25, 0.9, 0.9)])
def test_recall_of_the_hashed_search(spark, noise, threshold, least):
    """Share of the exact search's hits that hashing finds; none is found beside them."""
    v = near_vectors(spark, noise)
    catalogue = stored(v, F.col("start_s").cast("long")).cache()
    pairs = lambda df: {(r["source_id"], r["ref_source_id"]) for r in df.collect() if r["source_id"] != r["ref_source_id"]}
    exact, hashed = pairs(exact_top_k(v, catalogue, 12, threshold)), pairs(lsh_top_k(v, catalogue, 12, threshold))
    assert len(exact) > 500 and hashed <= exact
    assert len(hashed) / len(exact) >= least


def test_method_is_chosen(spark):
    v = near_vectors(spark, 0.05, 300).withColumn("source_id", F.lit("one"))
    got = [sorted((r["start_s"], r["ref_start_s"]) for r in self_anchors(v, SearchOptions(minimum_similarity=0.98, minimum_duration_seconds=1.0, method=m)).collect()) for m in ("exact", "hashed")]
    assert got[0] and len(set(got[0]) & set(got[1])) >= 0.98 * len(got[0])
    with pytest.raises(ValueError):
        SearchOptions(method="other")
