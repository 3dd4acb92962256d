import hashlib
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import queries, sketch


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(docs):
    got = sketch.edited(docs, k=20000).select("doc_id", "n_chars", "edited", sketch.as_text(F.col("sketch")).alias("f"), sketch.resemblance(F.col("sketch"), F.col("edited_sketch"), 20000).alias("e"), sketch.resemblance(F.col("sketch"), F.col("next_sketch"), 20000).alias("n")).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), reverse=True)
    want = []
    for i, (has, k, t) in enumerate(rows):
        n, h = rows[(i + 1) % len(rows)][2], len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want.append((str(k if has else None), len(t), e, round(alike(shingles(t), shingles(e)), 9), round(alike(shingles(t), shingles(n)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited, round(r.e, 9), round(r.n, 9)) for r in got) == sorted(want)


def test_merge_and_estimates(spark):
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1500, 4500)))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, None)], "g int, text string")
    s = sketch.with_sketch(df, F.col("text"), "s")
    one = {r.g: r.s for r in sketch.merge_groups(s, ["g"], "s").collect()}
    whole = sorted(x for r in s.where("g = 1").collect() for x in r.s)
    assert one[1] == sorted(set(whole))[:256] and 3 not in one
    pair = spark.createDataFrame([(s.where("g = 1").collect()[0].s, s.where("g = 1").collect()[1].s)], "x array<long>, y array<long>")
    x, y = F.col("x"), F.col("y")
    r = pair.select(sketch.resemblance(x, y).alias("j"), sketch.containment(x, y).alias("c"), sketch.distinct_shingles(x).alias("d")).first()
    assert abs(r.j - 1 / 3) < 0.12 and abs(r.c - 0.5) < 0.15 and abs(r.d - 2996) < 600


def test_one_row_and_empty(docs, empty):
    r = sketch.edited(docs.where("doc_id = 1")).first()
    t = docs.where("doc_id = 1").first().text
    assert r.edited == t[: len(t) - len(t) // 2] + t[: len(t) // 2]
    assert sketch.edited(empty).count() == 0


def bottom(text):
    return [int(text[i : i + 16], 16) for i in range(0, len(text), 16)]


def likeness(a, b, k=256):
    """By hand from two fingerprints, whose hashes are signed numbers in ascending order."""
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    union = sorted({sign(x) for x in bottom(a)} | {sign(x) for x in bottom(b)})[:k]
    both = {sign(x) for x in bottom(a)} & {sign(x) for x in bottom(b)}
    return sum(x in both for x in union) / len(union) if union else 1.0


@pytest.mark.parametrize("range_chars", [1 << 25, 700])
def test_query(tmp_path, docs, spark, monkeypatch, range_chars):
    """The registered query against hashes and likeness by hand, in few and in many ranges of ids."""
    monkeypatch.setattr(sketch, "RANGE_CHARS", range_chars)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_fingerprints(spark, str(tmp_path)).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), reverse=True)
    want = []
    for i, (has, k, t) in enumerate(rows):
        h = len(t) // 2
        e = t[: len(t) - h] + rows[(i + 1) % len(rows)][2][:h]
        want.append((str(k if has else None), len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(len(r.fingerprint) % 16 == 0 and len(r.fingerprint) <= 16 * 256 for r in got) and max(len(r.fingerprint) for r in got) == 16 * 256
    assert all(abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9 for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in of.values())
    ordered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
    alone = [i for i, r in enumerate(ordered) if [x.doc_id for x in ordered].count(ordered[(i + 1) % len(ordered)].doc_id) == 1 and [x.doc_id for x in ordered].count(r.doc_id) == 1]
    assert all(abs(ordered[i].near_next - likeness(ordered[i].fingerprint, ordered[(i + 1) % len(ordered)].fingerprint)) < 1e-9 for i in alone)
