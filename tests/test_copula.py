import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import synthesis


def test_two_peaks_and_a_long_tail(spark):
    """Quantiles of columns that no normal has, correlations of ranks, nulls, a constant, a column without values."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=4000)
    b = 0.8 * a + 0.6 * rng.normal(size=4000)
    rows = [(float(np.exp(2 * x)), float(-10 + y if y < 0 else 10 + y), 7, None, None if i % 5 == 0 else float(x)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    real = spark.createDataFrame(rows, "tail double, peaks double, same int, none double, some double").repartition(4)
    out = synthesis.sample(real, 6000, seed=2)
    x, y = (np.array([(r.tail, r.peaks) for r in df.collect()]) for df in (real, out))
    for j in range(2):
        for p in (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98):
            assert abs((x[:, j] <= np.quantile(y[:, j], p)).mean() - p) < 0.025
    assert y.min(0).tolist() >= x.min(0).tolist() and y.max(0).tolist() <= x.max(0).tolist()
    assert (np.abs(y[:, 1]) < 8).mean() < 0.02  # nothing much between the peaks
    rank = lambda v: v.argsort().argsort()
    assert abs(np.corrcoef(rank(x[:, 0]), rank(x[:, 1]))[0, 1] - np.corrcoef(rank(y[:, 0]), rank(y[:, 1]))[0, 1]) < 0.04
    row = out.agg(F.min("same"), F.max("same"), F.max("none"), F.corr(F.log("tail"), "some")).first()
    assert row[:3] == (7.0, 7.0, 0.0) and row[3] > 0.95
    alone = np.array([(r.tail, r.peaks) for r in synthesis.sample(real, 3000, preserve_correlations=False).collect()])
    assert abs(np.corrcoef(rank(alone[:, 0]), rank(alone[:, 1]))[0, 1]) < 0.06


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select(((F.col("id") * 37) % 1009).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.sqrt("id")).alias("y"))
    found = [synthesis.score_correlations(d, ["x", "y"], synthesis.marginals(d, ["x", "y"])) for d in (df.repartition(1), df.repartition(7))]
    assert np.allclose(*found, atol=1e-3)
    empty = df.limit(0)
    assert synthesis.sample(empty, 5).count() == 5 and (synthesis.score_correlations(empty, ["x", "y"], synthesis.marginals(empty, ["x", "y"])) == np.eye(2)).all()
