import json
import logging

import pytest
from pyspark.sql import functions as F

from veilspark import cli, schema
from veilspark.errors import VeilError
from veilspark.operators import audit, compliance, lineage, private_stats, verify
from veilspark.operators.deidentify import Config, deidentify


def test_findings_are_read_from_any_prose():
    assert verify.findings("none") == verify.findings("[]") == verify.findings("] [") == []
    got = verify.findings('Sure: [{"text": "Roe", "category": "NAME", "start": 3, "confidence": "0.7", "more": 1}, "x", {"text": null}] done')
    assert got == [{"text": "Roe", "category": "NAME", "start": 3, "confidence": 0.7}, {"text": "", "category": "UNKNOWN", "start": -1, "confidence": 0.5}]
    with pytest.raises(ValueError):
        verify.findings("[not json]")


@pytest.mark.parametrize("provider", ["anthropic", "openai"])
def test_requests_and_replies(provider):
    url, headers, body = verify.request("the text", provider, "m", "secret", "https://h.example.org/")
    assert url.startswith("https://h.example.org/v1/") and "the text" in body["messages"][-1]["content"] and body["max_tokens"] == 1024
    assert any("secret" in v for v in headers.values()) and ("system" in body) == (provider == "anthropic")
    for odd in ({}, {"content": []}, {"choices": [{}]}, {"content": "x"}, [], None, {"content": [{"text": 5}], "choices": [{"message": {"content": 5}}]}):
        assert verify.reply_text(provider, odd) == ""
    with pytest.raises(ValueError):
        verify.request("x", "other", "m", "k", "https://h")


def test_status():
    def send(url, headers, body, timeout):
        if "fail" in body["messages"][-1]["content"]:
            raise OSError("no network")
        return {"content": [{"text": '[{"text": "Roe"}]' if "Roe" in body["messages"][-1]["content"] else "[]"}]}

    check = verify.verifier("anthropic", "m", "https://h", "key", send)
    assert [check(x)[0] for x in ("Roe", "none", "fail", "  ")] == ["findings", "clean", "error", "clean"]
    assert verify.verifier("anthropic", "m", "https://h", "", send)("Roe") == ("skipped", [])


def frame(spark, rows):
    return schema.records(spark.createDataFrame([(json.dumps(r),) for r in rows], "j string"), F.lit("Patient"), F.col("j"), "CSV", F.lit("u"), F.monotonically_increasing_id())


def test_one_pass_gives_what_two_give(spark):
    rows = [{"id": "p1", "note": "Dr. Alan Poe, a@b.org, 2001-02-03"}, {"note": "plain"}, {"note": "tab\there"}, {"n": None}, {"note": "Patient: Jane Roe"}]
    df = frame(spark, rows)
    for config in (Config(date_shift_salt="s", show_offset=True), Config(date_shift=False), Config(date_shift_salt="s", audit_key="k", extra_patterns=(("p", "plain"),))):
        (a, x), (b, y) = deidentify(df, config), deidentify(df, config, once=True)
        assert sorted(r.data_json for r in a.collect()) == sorted(r.data_json for r in b.collect())
        assert sorted(r.checksum for r in a.collect()) == sorted(r.checksum for r in b.collect())
        drop = lambda log: sorted(str(r.asDict() | {"at": 0}) for r in log.collect())
        assert drop(x) == drop(y) and (x.count() > 0)
    clean = {r.data_json for r in deidentify(df, Config(date_shift=False))[0].collect()}
    assert '{"note": "plain"}' in clean and '{"note":"Patient: [PATIENT_NAME]"}' in clean


def test_json_files(spark, tmp_path, capsys):
    df = frame(spark, [{"id": "p1", "note": "mail a@b.org", "deep": {"x": [1, 2.50, True, None]}}, {"id": "p2", "note": "ä"}])
    data, out, log = (str(tmp_path / n) for n in ("d.json", "o.json", "a.json"))
    cli.save(df, data)
    assert len(json.loads((tmp_path / "d.json").read_text())["records"]) == 2
    back = cli.load(spark, data)
    assert sorted(json.dumps(json.loads(r.data_json)) for r in back.collect()) == sorted(json.dumps(json.loads(r.data_json)) for r in df.collect())
    assert {(r.id, r.checksum) for r in back.collect()} == {(r.id, r.checksum) for r in df.collect()}
    assert cli.main(["deidentify", data, "--out", out, "--audit", log, "--salt", "s"]) == 0
    assert "[EMAIL]" in (tmp_path / "o.json").read_text() and "a@b.org" not in (tmp_path / "o.json").read_text() + (tmp_path / "a.json").read_text()
    capsys.readouterr()
    assert cli.main(["audit", log]) == 0
    said = capsys.readouterr().out
    assert "Audit Log Summary" in said and "Total entries: 3" in said
    assert cli.main(["audit", log, "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)["entries"]) == 3
    assert cli.main(["audit", log, "--format", "markdown"]) == 0 and "Safe Harbor Identifiers" in capsys.readouterr().out


def test_audit_json_of_others(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"entries": [{"action": "PHI_REMOVED", "layer": "NER", "category": "PATIENT_NAME", "original": "John", "replacement": "[N]", "timestamp": "2024-01-02T03:04:05"}, {"action": "PHI_REMOVED", "category": "SSN"}]}))
    rows = sorted(audit.from_json(spark, str(p)).collect(), key=lambda r: r.seq)
    assert [r.category for r in rows] == ["PATIENT_NAME", "SSN"] and len(rows[0].original_hash) == 16 and rows[1].original_hash == "" and rows[0]["at"] is not None
    p.write_text('{"entries": []}')
    assert audit.from_json(spark, str(p)).count() == 0


def test_notes_of_verification(spark):
    def notes(*actions):
        rows = [("r", a, "LLM_VERIFY", "", "", "NONE", 1.0) for a in actions]
        return compliance.report(audit.entries(spark.createDataFrame(rows, "record_id string, action string, layer string, original string, replacement string, category string, confidence double")))

    done, left, found = notes("PHI_VERIFIED_CLEAN"), notes("PHI_VERIFIED_CLEAN", "PHI_VERIFICATION_SKIPPED"), notes("PHI_DETECTED_LLM", "PHI_VERIFIED_CLEAN")
    assert done.safe_harbor_compliant and any("LLM verification completed" in n for n in done.notes)
    assert not left.safe_harbor_compliant and any("did not complete" in n for n in left.notes)
    assert not found.safe_harbor_compliant and any("detected residual PHI" in n for n in found.notes)


def test_lineage_as_plain_data(spark):
    rows = [("a", "r", None, 0), ("b", "r", None, 1), ("c", "s", ["b"], 0)]
    out = lineage.to_dict(lineage.linked(spark.createDataFrame(rows, "node_id string, record_id string, parent_ids array<string>, seq long")))
    assert out["records"] == {"r": ["a", "b"], "s": ["c"]} and out["nodes"]["b"]["parent_ids"] == ["a"]


def test_low_budget_warns(caplog):
    budget = private_stats.Budget(1.0)
    with caplog.at_level(logging.WARNING):
        budget.spend(0.5)
        assert not caplog.records
        budget.spend(0.4)
    assert "low" in caplog.text


def test_audit_json_of_any_size(spark, tmp_path, monkeypatch):
    """A log is written and read without its rows on the driver, by several tasks, and with nothing left beside it."""
    n, path = 5000, str(tmp_path / "a.json")
    text = F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit('"} ], {ä\n\\ '), F.col("id").cast("string")))
    log = audit.entries(spark.range(n).repartition(3).select(F.col("id").cast("string").alias("record_id"), F.lit("PHI_REMOVED").alias("action"), F.lit("NER").alias("layer"), F.lit("x").alias("original"), text.alias("replacement"), F.lit("NAME").alias("category"), (F.col("id") / 4).alias("confidence"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 500_000).alias("at")))
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *a, **k: pytest.fail("rows on the driver"))
    for _ in range(2):
        audit.save_json(log, path, "r1")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.json"]
    whole = json.loads((tmp_path / "a.json").read_text())
    assert (whole["pipeline_run_id"], whole["summary"]["total_entries"], len(whole["entries"])) == ("r1", n, n)
    assert {e["seq"]: e["at"] for e in whole["entries"] if e["seq"] < 2} == {0: "1970-01-01T00:00:00", 1: "1970-01-01T00:00:00.500000"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        back = audit.from_json(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3 and '"multiLine"' not in back._jdf.queryExecution().toString()
        assert sorted(map(str, back.collect())) == sorted(str(r) for r in log.withColumn("replacement", F.coalesce("replacement", F.lit(""))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    audit.save_json(log.where("seq < 0"), path)
    assert json.loads((tmp_path / "a.json").read_text())["entries"] == [] and audit.from_json(spark, path).count() == 0


def test_json_file_of_many_records(spark, tmp_path, monkeypatch):
    """Records are written and read without rows on the driver, and are the same, whatever their data looks like."""
    n, path = 4000, str(tmp_path / "d.json")
    k = F.col("id").cast("string")
    j = F.when(F.col("id") == 1, None).when(F.col("id") == 2, "[1.50]").when(F.col("id") == 3, '"x"').otherwise(F.concat(F.lit('{"records":[{"id":"no"}],"n":1.50,"t":"\\"}],ä\\n '), k, F.lit('"}')))
    df = spark.range(n).repartition(3).select(k.alias("id"), F.lit("Patient").alias("resource_type"), j.alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("2024-01-02 03:04:05.5").cast("timestamp").alias("ingested_at"), F.concat(F.lit("c"), k).alias("checksum"))
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *a, **k: pytest.fail("rows on the driver"))
    cli.save(df, path)
    whole = json.loads((tmp_path / "d.json").read_text())["records"]
    assert len(whole) == n and {r["id"]: r["data"] for r in whole if len(r["id"]) == 1 and r["id"] in "123"} == {"1": None, "2": [1.5], "3": "x"} and whole[0]["ingested_at"] == "2024-01-02T03:04:05.500000"
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted((str(r.asDict() | {"data_json": 0}), r.data_json) for r in cli.load(spark, path).where("id not in ('1', '2', '3')").collect())
        assert got == sorted((str(r.asDict() | {"data_json": 0}), r.data_json) for r in df.where("id not in ('1', '2', '3')").collect())
        assert cli.load(spark, path).count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "cut.json").write_text((tmp_path / "d.json").read_text()[:-20])
    with pytest.raises(VeilError):
        cli.load(spark, str(tmp_path / "cut.json"))
