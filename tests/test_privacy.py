import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.errors import BudgetExhaustedError, KAnonymityError, LineageError, PipelineConfigError, ReidentificationRiskError
from veilspark.operators import kanonymity as ka
from veilspark.operators import lineage, pipeline, synthesis
from veilspark.operators import private_stats as ps
from veilspark.operators.deidentify import Config
from veilspark.schema import RECORDS


def frame(spark, *datas, kind="Observation"):
    return spark.createDataFrame([(str(i), kind, json.dumps(d), "CSV", "u", None, "c") for i, d in enumerate(datas)], RECORDS)


def test_k_anonymity(spark):
    df = spark.createDataFrame([(20, "M"), (20, "M"), (20, "M"), (30, "F"), (31, "F"), (None, None)], "age int, gender string")
    assert sorted(r.class_size for r in ka.classes(df, ["age", "gender"]).collect()) == [1, 1, 1, 3]
    with pytest.raises(KAnonymityError):
        ka.check(df, ["age", "gender"], 2)
    with pytest.raises(ValueError):
        ka.check(df, ["age"], 1)
    assert ka.check(df, ["none"], 2) and ka.check(ka.enforce(df, ["age", "gender"], 3), ["age", "gender"], 3)
    assert ka.enforce(df, ["age", "gender"], 2).count() == ka.enforce_by_window(df, ["age", "gender"], 2).count() == 3
    assert ka.enforce(df, ["age", "gender"], 2, {"age": ka.Rule("range", 10), "zip": ka.Rule("suppress")}).count() == 5


def test_generalisation(spark):
    df = spark.createDataFrame([("23.7",), ("20",), ("-3",), ("x",), (None,), ("inf",), ("nan",)], "v string")
    assert [r[0] for r in df.select(ka.by_range(F.col("v"), 5)).collect()] == ["20-24", "20-24", "-5--1", "x", None, "inf", "nan"]
    assert [r[0] for r in df.limit(1).select(ka.by_prefix(F.col("v"), 2)).collect()] == ["23"]


def test_l_diversity(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None)], "q int, s string")
    assert ka.check_diversity(df, ["q"], "s", 1) and ka.check_diversity(df, ["q"], "none", 9)
    with pytest.raises(KAnonymityError):
        ka.check_diversity(df, ["q"], "s", 2)


def test_budget():
    b = ps.Budget(1.0)
    for _ in range(100):
        b.spend(0.01)
    with pytest.raises(BudgetExhaustedError) as e:
        b.spend(0.001)
    assert e.value.epsilon_remaining < 1e-9 and b.low
    b.reset()
    assert b.epsilon_remaining == 1.0 and not b.can_afford(0.5, 0.1)


def test_mechanisms():
    x = np.array(ps.Laplace(0.5, 1.0, random.Random(1)).release_array([0.0] * 20000))
    assert abs(x.mean()) < 0.1 and abs(x.var() - 8) < 0.6
    y = np.array(ps.Gaussian(1.0, 1e-5, 1.0, random.Random(1)).release_array([0.0] * 20000))
    assert abs(y.std() - 4.84) < 0.15
    for bad in (lambda: ps.Laplace(0), lambda: ps.Gaussian(1, 0), lambda: ps.Budget(0)):
        with pytest.raises(ValueError):
            bad()


def test_private_stats(spark):
    df = frame(spark, {"dx": "flu", "v": {"x": 100}}, {"dx": "flu", "v": {"x": "200"}}, {"dx": "", "v": {"x": "none"}}, {"dx": "flu", "v": {"x": True}})
    q = [ps.Count("v.x"), ps.Count("obs"), ps.Count("nothing"), ps.Mean("v.x"), ps.Mean("absent"), ps.Histogram("dx"), ps.Count("v.x", group_by="dx"), ps.Mean("v.x", group_by="dx")]
    r = ps.private_stats(df, 1e7, q, ps.Budget(1e7), random.Random(1))
    v = r.values
    assert (v["count:v.x"], v["count:obs"], v["count:nothing"], v["histogram:dx"], v["count:v.x|group_by:dx"]) == (4, 4, 0, {"flu": 3}, {"flu": 3, "ungrouped": 1})
    assert abs(v["mean:v.x"] - 301 / 3) < 0.1 and abs(v["mean:absent"]) < 0.1 and set(v["mean:v.x|group_by:dx"]) == {"flu"} and r.epsilon_remaining < 1


def test_synthesis(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), "ab"[i % 2]) for i in range(200)], "x double, y double, c string")
    out = synthesis.sample(df, 2000, seed=3)
    a, b = synthesis.correlations(df, ["x", "y"]), synthesis.correlations(out, ["x", "y"])
    assert out.count() == 2000 and abs(a - b).max() < 0.05 and out.collect() == synthesis.sample(df, 2000, seed=3).collect()
    u = synthesis.evaluate(df, out)
    assert u.fidelity > 0.85 and u.ml_utility > 0.9 and set(u.column_scores) == {"x", "y", "c"}
    with pytest.raises(ReidentificationRiskError):
        synthesis.validate(df, df)
    with pytest.raises(ReidentificationRiskError):
        synthesis.validate(df, out, threshold=2.0, most_exact=1.0)
    assert synthesis.validate(df, out.limit(0)).passed


def test_distances_in_blocks(spark):
    rng = np.random.default_rng(0)
    real, syn = rng.random((300, 3)), rng.random((70, 3))
    frame_of = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    want = np.sqrt(((syn[:, None] - real[None]) ** 2).sum(2)).min(1)
    got = synthesis.closest(frame_of(real), frame_of(syn), block=16).orderBy("i").collect()
    assert np.allclose([r.dcr for r in got], want)


def test_records_to_synthetic_records(spark):
    df = frame(spark, *[{"glucose": 100.0 + i, "sub": {"age": i}, "dx": "ab"[i % 2], "tags": ["t"], "odd": [{}]} for i in range(40)])
    with pytest.raises(ReidentificationRiskError):  # two numbers leave little room between real rows
        synthesis.synthesize(df, 30, method="ctgan")
    out = synthesis.synthesize(df, 30, method="ctgan", check=False)
    rows = [json.loads(r.data_json) for r in out.collect()]
    assert len(rows) == 30 and set(rows[0]) == {"glucose", "sub.age", "dx", "tags"} and {r.source_format for r in out.collect()} == {"SYNTHETIC"}


def test_lineage(spark):
    rows = [("a", "r", None, 0), ("b", "r", None, 1), ("c", "r", None, 2), ("m", "s", ["c", "x1", "c"], 0), ("x1", "t", None, 0), ("lost", "u", ["gone"], 0)]
    nodes = lineage.linked(spark.createDataFrame(rows, "node_id string, record_id string, parent_ids array<string>, seq long"))
    assert lineage.trace(nodes, "c") == ["a", "b", "c"] and set(lineage.trace(nodes, "m")) == {"a", "b", "c", "x1", "m"} and lineage.trace(nodes, "m")[-1] == "m"
    assert {r.node_id for r in lineage.parents(nodes, "m").collect()} == {"c", "x1"} and lineage.parents(nodes, "lost").count() == 0
    for bad in (lambda: lineage.trace(nodes, "lost"), lambda: lineage.node(nodes, "zzz")):
        with pytest.raises(LineageError):
            bad()
    far = {(r.node_id, r.ancestor_id): r.distance for r in lineage.trace_all(nodes).collect()}
    assert far[("m", "a")] == 3 and far[("m", "m")] == 0 and len([k for k in far if k[0] == "m"]) == 5


def test_pipeline(spark):
    source = lambda s: frame(s, *[{"id": f"p{i}", "x": float(i * i), "y": float(100 - i), "mail": "a@b.org"} for i in range(30)], kind="Patient")
    r = pipeline.run(spark, [source, source], pipeline.PipelineConfig(generate_synthetic=True, validate_synthetic=False, synthetic_n=10))
    assert r.raw.count() == 60 and r.clean.where(F.contains("data_json", F.lit("a@b.org"))).count() == 0 and r.synthetic.count() == 10 and r.audit.count() == 120
    assert pipeline.run(spark, []).raw.count() == 0
    with pytest.raises(PipelineConfigError):
        pipeline.run(spark, [], pipeline.PipelineConfig(deidentify=False, generate_synthetic=True))
    done = pipeline.run(spark, [source], pipeline.PipelineConfig(deid=Config(date_shift=False)))
    assert done.lineage.groupBy("operation").count().count() == 2
