import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import fm_quality, queries


def test_identity_equals_pairs():
    rng = np.random.default_rng(0)
    size = fm_quality.WORDS + fm_quality.STATS * fm_quality.BINS
    model = 0.1, rng.normal(size=size), rng.normal(size=(size, fm_quality.FACTORS))
    idx, val = rng.choice(size, 12, replace=False), rng.random(12) / 5
    y = 0.1 + model[1][idx] @ val + sum(model[2][idx[i]] @ model[2][idx[j]] * val[i] * val[j] for i in range(12) for j in range(i))
    assert abs(fm_quality.predict(model, idx, val) - 1 / (1 + np.exp(-y))) < 1e-9


def test_learns_and_scores_every_row(spark, docs):
    good = [(i, "plain words in a calm order number " + str(i)) for i in range(60)]
    bad = [(100 + i, "WIN*** NOW$$$ " * 8 + str(i)) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fm_quality.train(df, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in fm_quality.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i < 100) for i in got)
    every = fm_quality.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)


def test_one_class_or_none(docs, empty, spark):
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert fm_quality.train(docs, one, F.lit(True)) == 1.0
    assert fm_quality.train(docs, one.limit(0), F.lit(True)) == 0.5
    assert fm_quality.train(empty, one, F.lit(True)) == 0.5
    assert fm_quality.score(empty, 0.5).count() == 0


def test_an_interaction_alone_separates():
    """Good texts have two words both or neither; no word, length or statistic tells anything by itself."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)]

    def text(a, b):
        words = [vocabulary[i] for i in rng.permutation(40)[:6]] + (["apple"] if a else ["arrow"]) + (["berry"] if b else ["bones"])
        return " ".join(words[i] for i in rng.permutation(8))

    def rows(n):
        flags = [(int(rng.integers(2)), int(rng.integers(2))) for _ in range(n)]
        return [fm_quality.features(text(a, b)) for a, b in flags], np.array([a == b for a, b in flags], np.float32)

    xs, y = rows(1500)
    model = fm_quality.fit(xs, y)
    held, z = rows(400)
    right = np.mean([(fm_quality.predict(model, *x) >= 0.5) == bool(t) for x, t in zip(held, z, strict=True)])
    w0, w, v = model
    alone = np.mean([(fm_quality.predict((w0, w, np.zeros_like(v)), *x) >= 0.5) == bool(t) for x, t in zip(held, z, strict=True)])
    assert right > 0.9 and alone < 0.65


def brute(model, text):
    """The score from the definition: all pairs of features, one by one."""
    w0, w, v = model
    idx, val = fm_quality.features(text)
    y = w0 + sum(w[i] * x for i, x in zip(idx, val, strict=True))
    y += sum(float(v[idx[a]] @ v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
    return 1 / (1 + np.exp(-y))


def test_query_scores_as_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fm_quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"), queries.remainder("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 4000}
    got = {r.doc_id: r for r in queries.op3_fm_quality(spark, d).collect()}
    assert len(got) == docs.count()
    assert all(abs(got[i].score - brute(model, t)) < 1e-5 for i, t in texts.items())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got.values())
