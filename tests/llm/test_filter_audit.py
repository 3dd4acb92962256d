import itertools
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.llm import filter_audit, queries


def brute(rows, labels):
    """rows (doc_id, text, lang) -> all rows of the audit, by applying every order one after another."""
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        return out + "E" * (t in least and (i is None or i > least[t]))

    parts = {}
    for i, t, lang in rows:
        parts.setdefault(lang or "", []).append((i, fails(i, t)))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.01"
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(queries.OP13)
    df = queries.op13_filter_audit(spark, d)
    rows = sorted(map(tuple, df.collect()))
    assert df.columns == rel.columns and rows == sorted(rel.fetchall())
    assert len(rows) == 600 * len({r[0] for r in rows})


@pytest.mark.parametrize("parts", [1, 6])
def test_odd_rows_equal_brute_force(spark, docs, parts):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows += [(None, None, None), (None, "a text without an id here", ""), (500, "", "fr"), (501, None, "fr"), (7, "SHOUT " * 120, "fr"), (7, "SHOUT " * 120, "fr")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, quality int").repartition(parts)
    got = filter_audit.audit_corpus(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(spark, empty, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_corpus(empty, labels).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit_corpus(docs, labels).collect())


def test_each_state_is_visited_once(spark, docs):
    """Two filters: 4 states, of which 3 have edges; null verdicts pass; steps add up."""
    verdicts = docs.select(F.lit("p").alias("part"), F.lit(False).alias("good"), F.lit(False).alias("toxic"), (F.col("doc_id") % 2 == 0).alias("f0"), (F.col("doc_id") % 3 == 0).alias("f1"), (F.col("doc_id") < 9).alias("f2"))
    assert sorted(t.first()["state"] for t in filter_audit._states(verdicts.na.fill(False), ["f0", "f1", "f2"])) == list(range(7))
    out = filter_audit.audit(docs, {"x": F.col("doc_id") % 2 == 0, "y": F.col("doc_id") % 3 == 0}, F.lit(None), F.lit(None), F.lit(None))
    rows = {(r.filter_order, r.step): r for r in out.collect()}
    n = docs.count()
    assert all(rows[o, 1].kept + rows[o, 1].removed == n and rows[o, 2].kept + rows[o, 2].removed == rows[o, 1].kept for o in ("xy", "yx"))
    assert rows["xy", 2].kept == rows["yx", 2].kept and rows["xy", 1].shapley == rows["xy", 1].removed + rows["yx", 2].removed
