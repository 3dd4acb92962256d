import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import closest as index


def frame(spark, x, parts=3):
    return spark.createDataFrame([(k, [float(v) for v in row], "x") for k, row in enumerate(x)], "k long, v array<double>, i string").repartition(parts).orderBy("k").select("v", "i")


def brute(real, queries):
    return np.sqrt(((queries[:, None] - real[None]) ** 2).sum(2)).min(1)


def answers(df):
    return [r.dcr for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("block", [7, 10_000])
@pytest.mark.parametrize("width", [1, 2, 9])
def test_equals_brute_force(spark, width, block, monkeypatch):
    """Clusters, outliers, rows met exactly, and a third of both tables one row; rings and shares small enough that there are many."""
    monkeypatch.setattr(index, "RING_ROWS", 5)
    rng = np.random.default_rng(width)
    centres = rng.normal(0, 5, (6, width))
    real = np.r_[centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.1, (300, width)), rng.normal(0, 20, (40, width)), np.repeat(centres[:1], 170, 0)]
    asked = np.r_[centres[rng.integers(0, 6, 200)] + rng.normal(0, 0.1, (200, width)), rng.normal(0, 30, (30, width)), real[:50], np.repeat(centres[:1] + 0.01, 140, 0)]
    got = answers(index.closest(frame(spark, real), frame(spark, asked), block))
    assert len(got) == len(asked) and np.allclose(got, brute(real, asked), atol=1e-12)
    assert sum(d == 0 for d in got) >= 50


def test_far_fewer_pairs_than_all(spark):
    rng = np.random.default_rng(0)
    real, asked = rng.random((6000, 2)), rng.random((4000, 2))
    out = index.closest(frame(spark, real), frame(spark, asked)).orderBy("i").collect()
    assert np.allclose([r.dcr for r in out], brute(real, asked))
    assert sum(r.compared for r in out) < 0.05 * 6000 * 4000


def test_close_and_huge_values_and_missing_ones(spark):
    real = np.array([[1e6, 1e6], [1e6 + 1e-6, 1e6], [0.0, 0.0], [1e-9, 0.0]])
    assert answers(index.closest(frame(spark, real), frame(spark, real))) == [0.0] * 4
    nan = spark.createDataFrame([([float("nan"), 3.0],), ([None, 4.0],)], "v array<double>")
    assert answers(index.closest(nan, nan)) == [0.0, 0.0]
    assert np.allclose(answers(index.closest(frame(spark, [[0.0, 0.0]]), nan)), [3.0, 4.0])


def test_empty_sides(spark):
    one, none = frame(spark, [[1.0, 2.0]]), spark.createDataFrame([], "v array<double>")
    assert index.closest(none, one).count() == 0 and index.closest(one, none).count() == 0 and index.closest(none, none).count() == 0


def test_plan_of_a_million_rows_each(spark):
    """Nothing of the tables is brought to the driver for the plan but pivots and counts: no query set is broadcast and no side is collected."""
    v = F.array(F.rand(1), F.rand(2), F.rand(3))
    n = 30_000
    plan = index.closest(spark.range(n).select(v.alias("v")), spark.range(n).select(v.alias("v")))
    text = plan._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "FlatMapCoGroupsInArrow" in text
    assert plan.agg(F.sum("compared")).first()[0] < 0.1 * n * n
