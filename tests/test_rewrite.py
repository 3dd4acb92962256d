"""The native layers against their Python counterparts, on texts put together from what the rules look for."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import dates, names, phi, rewrite
from veilspark.operators import deidentify as engine

PARTS = [
    "123-45-6789", "000-12-3456", "SSN: 123456789", "(555) 123-4567", "+1 555.123.4567", "a.b+c@mail.example.org", "MRN-12345", "Account # 1234567", "Member ID: AB12CD34", "NPI 12345678", "VIN 1HGCM82633A004352", "1HGCM82633A004352", "UDI (01)0012345",
    "10.0.0.255", "https://x.example/a?b=1", "62704-1234", "12345", "17 Old Oak Street", "5 Rd", "9 a b c Dr x Ave", "Dr. Jane Doe", "patient: Bob", "Patient: John Q Public", "Name Ann Lee Ray Jo", "mrs.  Ann", "Dr Patient Smith", "Pt Bo Ra", "Resident: Jo Ji", "2025-03-15", "2025-13-45", "2025-02-29",
    "0000-01-01", "0001-01-01", "9999-12-31", "03/20/2025", "13/20/2025", "03-21-2025", "20250322", "99999999", "2025-03-15T10:30:00", "٢٠٢٥-٠٣-١٥", "ünï", "漢字", "🙂", '"', "\\", "\n", "\t", "plain", "words", ",", ".", ":", "", " ", "1", "\x1f", "\x85", "é1",
]
WHOLE = ["1/5/2020", " 3/4/1960 ", "2024-3-5", "2024115", "20241132", "2024131", "202413", "13/13/2020", "1-1-0999", " 2024-03-05\n", "2024-3- 5", "12/31/9999", "3/4/60", "٣/٤/١٩٦٠", "1 2 2020", "2024--3-5"]


def texts(n=1500):
    rng = random.Random(11)
    return WHOLE + [rng.choice(["", " ", " ", "-"]).join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["12345 " * 400, "1 Oak St " * 300]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, t string").repartition(4).cache()


def test_names_and_rules(table):
    rows = table.withColumn("n", names.spans(F.col("t"))).withColumn("nt", names.redacted(F.col("t"), F.col("n"))).withColumn("s", phi.scan(F.col("t"))).withColumn("r", phi.redacted(F.col("t"))).collect()
    by_name, by_rule = names.Names(), phi.Matcher()
    for r in rows:
        new, found = by_name.redact(r.t)
        assert (r.nt, [(x.original, x.start, x.stop) for x in r.n]) == (new, [(e.text, e.start, e.end) for e in found]), r.t
        new, got = by_rule.redact(r.t)
        assert [(x.category, x.original, x.replacement, x.start, x.end) for x in r.s] == [(m.category, m.original, m.replacement, m.start, m.end) for m in got], r.t
        assert r.r == new, r.t


@pytest.mark.parametrize("timed", [True, False])
def test_dates(table, timed):
    shifter = dates.Shifter(timed=timed)
    for days in (1, -400):
        df = table.withColumn("days", F.lit(days))
        df = dates.shifted(dates.shifted(df, "t", "days", "d", timed), "t", "days", "x", timed, False)
        for r in df.collect():
            assert (r.d.text, r.d.n) == shifter.value(r.t, days), r.t
            assert (r.x.text, r.x.n) == shifter.text(r.t, days), r.t


def records(spark):
    rng, all_ = random.Random(2), texts(300)
    tree = lambda depth: rng.choice([lambda: rng.choice(all_), lambda: rng.choice([1, 2.5, True, None, -3]), lambda: [tree(depth - 1) for _ in range(rng.randint(0, 3))], lambda: {rng.choice(["a", "b:", 'q"', "Patient: Jo Smith", "62704"]): tree(depth - 1) for _ in range(3)}])() if depth else rng.choice(all_)
    data = [json.dumps({"id": f"p{k}", "x": tree(3), "y": tree(2)}, ensure_ascii=k % 2 == 0, indent=k % 3 or None) for k in range(250)] + [None, "{}", '{"a": ""}', '"12345"', '["a@b.org"]']
    return spark.createDataFrame([(str(k), "Patient", d, "CSV", "u", "") for k, d in enumerate(data)], "id string, resource_type string, data_json string, source_format string, source_uri string, checksum string").repartition(3)


@pytest.mark.parametrize("more", [{}, {"date_shift": False}, {"show_offset": True, "compat_dates": True}])
def test_engine_equals_its_python_form(spark, more):
    config, df = engine.Config(date_shift_salt="a salt", **more), records(spark)
    clean, log = engine.deidentify(df, config)
    plan = clean._jdf.queryExecution().toString() + log._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # A rule that never matches makes it a plug-in's run.
    other, other_log = engine.deidentify(df, engine.Config(date_shift_salt="a salt", extra_patterns=(("never", "\x00never"),), **more))
    assert "ArrowEvalPython" in other._jdf.queryExecution().toString()
    parsed = lambda d: {r.id: r.data_json and json.loads(r.data_json) for r in d.collect()}
    assert parsed(clean) == parsed(other)
    listed = lambda d: sorted((str(r.record_id), r.seq, r.action, r.layer, r.original_hash, r.replacement, r.category, r.confidence) for r in d.collect())
    assert listed(log) == listed(other_log)


def test_json_text_stays_but_for_its_values(spark):
    """Of a text with a change only blanks between its parts go; one without is the same."""
    text, plain = '{ "12345":\t"12345", "n" : 1.50, "e":"\\u00e9\\n", "e":"a\\"b 12345" }', '{ "n" : [1.50, "x" ] }'
    df = spark.createDataFrame([(0, text), (1, plain)], "k int, j string")
    new = F.transform(rewrite.json_strings(F.col("j")), lambda s: F.when(F.contains(s["value"], F.lit("12345")), F.replace(s["value"], F.lit("12345"), F.lit("[Z\n]"))))
    got = [r[0] for r in df.orderBy("k").select(rewrite.joined_json(F.col("j"), rewrite.json_strings(F.col("j")), new)).collect()]
    assert got == ['{"12345":"[Z\\n]","n":1.50,"e":"\\u00e9\\n","e":"a\\"b [Z\\n]"}', plain]


def test_audit_alone_needs_no_filter_over_the_layers(spark):
    """Entries are exploded without a filter that holds all layers in one expression; and who reads the entries alone does not make the JSON."""
    df = records(spark)
    clean, log = engine.deidentify(df, engine.Config(date_shift_salt="a salt"))
    plan = log.groupBy("layer", "category", "action").count()._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x.split("(")[0] and "RLIKE" in x]
    assert "to_json" not in plan and "StructsToJson" not in plan
    assert {r.record_id for r in log.collect()} == {r.id for r in df.where("data_json is not null").collect()}
    assert log.where("seq is null or action is null").count() == 0


def test_small_sources_are_dealt_out(spark, tmp_path):
    """A file of few bytes is no single task, however many rows it has; of a larger source nothing is moved. Records and entries are the same."""
    path = str(tmp_path / "t")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("Patient").alias("resource_type"), F.lit('{"id":"p","note":"mail a@b.org"}').alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("").alias("checksum"))
    rows.coalesce(1).write.parquet(path)
    before, seen = spark.conf.get("spark.sql.files.openCostInBytes"), []
    try:
        for cost in (before, "1"):
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            clean, log = engine.deidentify(spark.read.parquet(path), engine.Config(date_shift_salt="a salt"))
            moved = "RoundRobinPartitioning" in clean._jdf.queryExecution().executedPlan().toString()
            assert moved is (cost == before) and (clean.select(F.spark_partition_id()).distinct().count() > 1) is moved
            seen.append((sorted(map(str, clean.collect())), sorted(str(r.asDict() | {"at": 0}) for r in log.collect())))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert seen[0] == seen[1] and len(seen[0][0]) == 3000 and len(seen[0][1]) == 6000
