import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.errors import BudgetExhaustedError
from veilspark.operators import private_stats as ps

SECRET = "a secret of this release"
ASKED = [ps.Count("v"), ps.Count("v", group_by="dx"), ps.Mean("v", 0, 300), ps.Mean("v", 0, 300, group_by="dx"), ps.Histogram("dx"), ps.Count("none")]


def records(spark):
    data = [{"dx": "flu", "v": 100}, {"dx": "flu", "v": "200"}, {"dx": "", "v": "x"}, {"v": 50}, {"dx": "|", "v": 400}]
    return spark.createDataFrame([("Patient", json.dumps(d)) for d in data], "resource_type string, data_json string").repartition(3)


def test_answers_are_those_of_the_driver_without_noise(spark):
    df = records(spark)
    got = {}
    for r in ps.release(df, 1e9, ASKED, secret=SECRET).collect():
        if r.key is None:
            got[r.query] = r.value
        else:
            got.setdefault(r.query, {})[r.key] = r.value
    want = ps.private_stats(df, 1e9, ASKED).values
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())


def test_noise_is_drawn_once(spark):
    df = records(spark)
    out = ps.release(df, 0.5, ASKED, secret=SECRET)
    first = sorted(map(str, out.collect()))
    assert first == sorted(map(str, out.collect())) == sorted(map(str, ps.release(df.repartition(5), 0.5, ASKED, secret=SECRET).collect()))
    assert first != sorted(map(str, ps.release(df, 0.5, ASKED, secret=SECRET + ".").collect())) and first != sorted(map(str, ps.release(df, 0.5, ASKED).collect()))
    for mode in ("simple", "extended"):
        assert SECRET not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_noise_is_laplace(spark):
    n = 40_000
    x = np.array([r[0] for r in spark.range(n).select(ps.keyed_laplace(F.lit(5.0), F.lit(2.0), F.lit(SECRET), F.lit("q"), F.col("id"))).collect()]) - 5
    assert abs(np.mean(x)) < 0.06 and abs(x.var() - 8) < 0.5
    # Its distribution, point by point.
    for at in (-6, -2, -0.5, 0, 0.5, 2, 6):
        want = 0.5 * math.exp(at / 2) if at < 0 else 1 - 0.5 * math.exp(-at / 2)
        assert abs((x <= at).mean() - want) < 0.01
    u = np.array([r[0] for r in spark.range(n).select(ps.keyed_uniform(F.lit(SECRET), F.col("id"))).collect()])
    assert 0 < u.min() and u.max() < 1 and len(set(u)) == n and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
    one = spark.range(1).select(ps.keyed_uniform(F.lit("k"), F.lit("ab"), F.lit("c")).alias("a"), ps.keyed_uniform(F.lit("k"), F.lit("a"), F.lit("bc")).alias("b")).first()
    assert one.a != one.b


def test_many_groups_budget_and_errors(spark):
    df = spark.range(20_000).select(F.lit("Patient").alias("resource_type"), F.to_json(F.struct(F.col("id").cast("string").alias("g"))).alias("data_json"))
    out = ps.release(df, 1.0, [ps.Count("g", group_by="g")], secret=SECRET)
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("value") == 0).cast("int")).alias("none"), F.max("value").alias("most")).first()
    assert row.n == 20_000 and 0.2 < row.none < 0.4 and row.most > 5
    budget = ps.Budget(1.0)
    ps.release(df, 0.6, ASKED[:2], budget)
    assert [e.label for e in budget.entries] == ["count:v", "count:v|group_by:dx"] and abs(budget.epsilon_remaining - 0.4) < 1e-9
    with pytest.raises(BudgetExhaustedError):
        ps.release(df, 0.6, ASKED[:1], budget)
    for bad in (lambda: ps.release(df, 0, ASKED), lambda: ps.release(df, 1, []), lambda: ps.release(df, 1, ASKED, secret="short")):
        with pytest.raises(ValueError):
            bad()
