"""The approximate vector search: recall on clustered and unclustered vectors, whole probes equal the exact search, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.operators import cells, retrieval


def vectors_of(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    return spark.createDataFrame([(k, (centres[k % 30] + spread * rng.normal(size=16)).tolist()) for k in range(3000)], "vec_id long, embedding array<double>")


def asked_of(v):
    return v.where("vec_id % 60 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@pytest.mark.parametrize("spread,share", [(0.2, 0.05), (0.2, None), (3.0, None)])
def test_recall(spark, spread, share):
    v = vectors_of(spark, spread)
    out = cells.recall(cells.approximate_nearest(asked_of(v), v, 5, share=share), retrieval.nearest(asked_of(v), v, 5)).first()
    assert out.queries == 50 and out.wanted == 250 and out.found >= 225


def test_share_follows_the_order_of_the_vectors(spark):
    need = [cells.needed_share(*cells.fit_cells(vectors_of(spark, spread), 54), 5, 0.95) for spread in (0.2, 3.0)]
    assert need[0] < 0.1 < need[1] <= 1.0


def test_all_cells_are_the_exact_search(spark):
    v = vectors_of(spark, 1.0)
    got = cells.approximate_nearest(asked_of(v), v, 7, cells=9, share=1.0, shard_numbers=1 << 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.nearest(asked_of(v), v, 7).collect()))


def test_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = cells.approximate_nearest(q, v, 5, share=1.0).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}
    assert cells.approximate_nearest(q, v.limit(0)).collect() == [] and cells.approximate_nearest(q.limit(0), v).collect() == []
