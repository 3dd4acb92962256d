import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from veilspark.llm import line_dedup, near_copies, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_rejects_by_score(stages, spark):
    before, after = stages[0]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) > 0.9 * len(right) and 0 < len(kept) < before.count()


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages[2]
    groups = {r.doc_id: r.component_id for r in near_copies.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(i for i, c in groups.items() if i == c)


def test_mix_repeats_rows(stages):
    before, after = stages[3]
    n = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert max(n.values()) <= 2
    total = sum(size(r.text) for r in before.collect())
    taken = sum(size(r.text) for r in after.collect())
    assert abs(taken - 1.5 * total) < 0.15 * total


def test_tokens_decode(stages):
    before, after = stages[4]
    assert after.count() == before.count() and after.where(~F.col("decodes")).count() == 0


def test_run_gives_the_last_stages_rows(stages, spark):
    assert sorted(map(str, cp.run(spark, DATA).select("doc_id", "n_tokens").collect())) == sorted(map(str, stages[4][1].select("doc_id", "n_tokens").collect()))


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))


def test_short_pages_lose_their_furniture(spark):
    head, foot = "Menu of the site with all its many parts", "All rights reserved, write to the owner of the site"
    rows = [(i, f"{head}\nown words {i}\n{foot}", "en", "s", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.lines(spark, docs, DATA).collect()}
    assert got == {i: (f"own words {i}", len(f"own words {i}")) for i in range(20)}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, n_lines int, n_dropped int, __score double, __key string, fp long, key string, size int, token_ids string, decoded string, h int"


def odd_rows():
    text = " ".join(f"w{i}" for i in range(60))
    base = [(1, text, "en", "s"), (None, text, "en", "s"), (None, "other words " * 9, None, None), (2, None, "en", "s"), (3, "", None, "s"), (4, " \n\t", "en", None), (5, "x " * 9000, "en", "t")]
    base += [(1, text, "en", "s"), (None, None, None, None), (6, text + " end", "en", "t")]
    return [(*r, None if r[1] is None else len(r[1]), 0.25, "r", 7, 8, 0.75, "k", 9, "q", 3, "t", "d", 2) for r in base]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_rows(spark, name):
    docs = spark.createDataFrame(odd_rows(), ODD)
    stage = dict(cp.STAGES)[name]
    rows = stage(spark, docs, DATA).collect()
    known = {tuple(map(str, r)) for r in docs.collect()}
    if name == "bpe":
        assert len(rows) == docs.count() and all(r.decodes for r in rows)
    elif name == "line_dedup":
        assert len(rows) == docs.count() and {r.score for r in rows} == {0.25} and {(r.n_lines, r.n_dropped) for r in rows} == {(7, 8)}
    else:
        assert {tuple(map(str, r)) for r in rows} <= known  # further columns are as they were
    if name == "near_dedup":
        got = sorted((str(r.doc_id), (r.text or "")[:5]) for r in rows)
        # 1 for its copies and its near copy, 2 for all without words, one row each of the others
        assert got == sorted([("1", "w0 w1"), ("None", "other"), ("2", ""), ("5", "x x x")])
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_near_dedup_of_rows_without_ids(spark):
    rows = [(1, "one text of some words"), (None, "one text of some words"), (None, "quite another text than that"), (None, "quite another text than that")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, cp.near_dedup(spark, docs, DATA).collect())) == sorted([str(docs.collect()[0]), str(docs.collect()[2])])


def test_quality_without_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(odd_rows(), ODD)
    assert cp.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_lines_by_brute_force(stages):
    before, after = stages[1]
    rows = before.collect()
    pages = {}
    for r in rows:
        for x in set((r.text or "").split("\n")):
            if x.strip(" \t\n\x0b\f\r"):
                pages[r.source, x] = pages.get((r.source, x), 0) + 1
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + 1
    cut = {k for k, n in pages.items() if n > 1 and n - 1 > line_dedup.RATIO * (total[k[0]] - 1 + line_dedup.PRIOR)}
    want = sorted((r.doc_id, "\n".join(x for x in r.text.split("\n") if (r.source, x) not in cut)) for r in rows)
    assert sorted((r.doc_id, r.text) for r in after.collect()) == want and all(r.n_chars == len(r.text) for r in after.collect())
