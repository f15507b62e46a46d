"""The inverted file against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import matching as M


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors around 60 centres, and one vector 600 times, which crowds its cell."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 32)) * 0.4
    x = np.concatenate([x, np.repeat(x[:1], 600, axis=0)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, f"s{i % 5}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (9000, "s1", None)], "product_id long, store string, embedding array<double>").repartition(4)


def test_recall_and_bounds(spark, clustered, tmp_path):
    index = M.InvertedFile.build(clustered, str(tmp_path / "ix"), cells=64, block_rows=200)
    assert index.vectors.count() == 3600
    blocks = index.vectors.groupBy("cell", "block").count().agg(F.max("count")).first()[0]
    assert blocks <= 300
    exact = M.knn(clustered.filter("embedding is not null"), clustered.filter("embedding is not null"), 10, 0.6)
    few = M.recall(index.knn(clustered, 10, 0.6, probes=8, block_rows=700), exact).first()
    assert few.pairs == exact.count() and few.recall >= 0.95
    again = M.InvertedFile(spark, str(tmp_path / "ix"))  # from the stored tables alone
    whole = again.knn(clustered, 10, 0.6, probes=64)
    assert {tuple(r) for r in whole.select("id", "match_id", "rank").collect()} == {tuple(r) for r in exact.select("id", "match_id", "rank").collect()}


def test_other_groups_only(spark, clustered, tmp_path):
    index = M.InvertedFile.build(clustered, str(tmp_path / "ix"), group="store", cells=8)
    some = clustered.filter("embedding is not null and product_id < 100")
    got = index.knn(some, 3, 0.5, probes=8, other_group="store")
    want = M.knn(some, clustered.filter("embedding is not null"), 3, 0.5, other_group="store")
    assert {tuple(r) for r in got.select("id", "match_id").collect()} == {tuple(r) for r in want.select("id", "match_id").collect()}
    assert got.filter(F.col("id") % 5 == F.col("match_id") % 5).count() == 0
