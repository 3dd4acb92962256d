import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.errors import DateShiftError
from veilspark.functions import dates, phi
from veilspark.functions.names import Names
from veilspark.functions.trees import flatten, strings
from veilspark.operators import audit, compliance
from veilspark.operators.deidentify import Config, deidentify, ensure_salt
from veilspark.schema import RECORDS

SALT = "test salt"


def frame(spark, *datas):
    rows = [(str(i), d.get("resourceType", "Patient"), json.dumps(d), "CSV", "u", None, "") for i, d in enumerate(datas)]
    return spark.createDataFrame(rows, RECORDS)


def test_rules_find_and_replace():
    m = phi.Matcher({"badge": r"B-\d+"})
    text = "SSN 123-45-6789, call 555-123-4567, mail a.b@c.org, MRN-12345, Account #9876543210, 10.0.0.1, https://x.org/y z, B-77"
    new, got = m.redact(text)
    assert {g.category for g in got} >= {"SSN", "PHONE", "EMAIL", "MRN", "ACCOUNT_NUMBER", "IP_ADDRESS", "URL", "badge"}
    assert all(x not in new for x in ("123-45-6789", "555-123-4567", "a.b@c.org", "12345", "10.0.0.1", "x.org", "B-77")) and "[BADGE]" in new
    assert m.redact("Stable on current therapy.") == ("Stable on current therapy.", [])


def test_invalid_ssn_areas_are_none():
    for bad in ("000-12-3456", "666-12-3456", "912-12-3456", "123-00-3456", "123-45-0000"):
        assert "SSN" not in {g.category for g in phi.Matcher().scan(bad)}


def test_overlaps():
    text = "62704 Main Street here"
    assert phi.Matcher().redact(text)[0] == "[ADDRESS] here"
    assert phi.Matcher().redact(text, compat_splice=True)[0] == "[ZIP]ESS] here"


def test_native_scan_agrees_and_survives_long_texts(spark):
    texts = ["call 555-123-4567 or 555.123.4568", "u@x.org v@y.com", "12 " + "word " * 30000, "x" * 50, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    m = phi.Matcher()
    for category in phi.BY_CATEGORY:
        want = [sum(g.category == category for g in m.scan(t or "")) for t in texts]
        assert [r[0] for r in df.select(phi.count(F.col("t"), category)).collect()] == want, category


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789-. @abSN:MR#\n", max_size=60))
def test_redaction_leaves_nothing_of_a_match(text):
    new, got = phi.Matcher().redact(text)
    assert bool(got) == (new != text) or not got


def test_names():
    n = Names()
    assert n.redact("Patient: John Smith was seen by Dr. Jane Doe")[0] == "Patient: [PATIENT_NAME] was seen by Dr. [PATIENT_NAME]"
    got = n.extract("Client: Ann Lee, Mrs. Ann Lee, Resident Bob Ray")
    assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False)) and {g.category for g in got} == {"PATIENT_NAME"}


def test_offsets_and_shifts(spark):
    with pytest.raises(ValueError):
        dates.check(" ")
    with pytest.raises(DateShiftError):
        dates.check("x", (5, 5))
    df = spark.createDataFrame([("a", "2025-01-31"), ("a", "2025-03-15"), ("b", "0001-01-02"), (None, None)], "p string, d string")
    rows = df.select("p", "d", dates.offset(F.col("p"), SALT).alias("o"), dates.shift_date(F.col("d"), dates.offset(F.col("p"), SALT)).alias("s")).collect()
    assert rows[0].o == rows[1].o and -365 <= rows[0].o <= 365 and (rows[1].s - rows[0].s).days == 43


def test_text_dates():
    s = dates.Shifter()
    assert s.text("on 2025-03-15 and 03/20/2025, 03-21-2025, 20250322", 1) == ("on 2025-03-16 and 03/21/2025, 03-22-2025, 20250323", 4)
    assert s.value("2025-03-15T10:30:00", 2) == ("2025-03-17T10:30:00", 1)
    assert dates.Shifter(timed=False).value("2025-03-15T10:30:00", 2) == ("2025-03-15T10:30:00", 0)
    assert s.value("1/5/2020", 1) == ("01/06/2020", 1)
    assert s.text("99999999 and 9999-12-31", 5) == ("99999999 and 9999-12-31", 0)


def test_ages(spark):
    df = spark.sql("SELECT explode(array(date'1931-01-01', date'1960-01-01', date_sub(date'2026-01-01', 89*365+364), date_sub(date'2026-01-01', 90*365))) b")
    ref = F.lit("2026-01-01").cast("date")
    got = df.select(F.datediff(ref, dates.collapse_age(F.col("b"), ref))).collect()
    assert [r[0] for r in got] == [32850, 24107, 89 * 365 + 364, 32850]


def test_engine(spark):
    data = {"id": "p1", "name": [{"family": "Smith"}], "note": "Patient: Jane Roe, SSN 123-45-6789, seen 2025-03-15 and 2025-03-20", "n": 5, "ok": True, "list": ["a@b.org", None, 1.5]}
    obs = {"resourceType": "Observation", "id": "o9", "subject": {"reference": "Patient/p1"}, "effectiveDateTime": "2025-03-15T10:30:00"}
    clean, log = deidentify(frame(spark, data, obs), Config(date_shift_salt=SALT))
    got = {r.id: json.loads(r.data_json) for r in clean.collect()}
    new = got["0"]
    assert "Jane" not in new["note"] and "123-45-6789" not in new["note"] and new["list"][0] == "[EMAIL]" and (new["n"], new["ok"], new["list"][1:]) == (5, True, [None, 1.5])
    days = re.findall(r"\d{4}-\d{2}-\d{2}", new["note"])
    assert got["1"]["effectiveDateTime"][:10] == days[0] != "2025-03-15"
    entries = log.orderBy("record_id", "seq").collect()
    assert [e.layer for e in entries if e.record_id == "0"] == ["NER", "PATTERN", "PATTERN", "DATE_SHIFT"]
    assert "shifted_dates=2" in [e.replacement for e in entries if e.layer == "DATE_SHIFT"] and not any("offset" in e.replacement for e in entries)
    assert all(len(e.original_hash) == 16 for e in entries)
    assert clean.where(F.col("checksum") == "").count() == 0


def test_engine_needs_a_salt(spark):
    with pytest.raises(ValueError):
        deidentify(frame(spark, {"id": "x"}), Config())
    assert ensure_salt(Config()).date_shift_salt


def test_verifier_and_compliance(spark):
    df = frame(spark, {"id": "x", "a": "text", "b": ["more"]})
    say = lambda status, found: Config(date_shift=False, llm_verification=True, verifier=lambda t: (status, found))
    for status, found, action, fine in (("clean", [], "PHI_VERIFIED_CLEAN", True), ("findings", [{"text": "Bob", "category": "NAME"}], "PHI_DETECTED_LLM", False), ("skipped", [], "PHI_VERIFICATION_SKIPPED", False), ("error", [], "PHI_VERIFICATION_ERROR", False)):
        _, log = deidentify(df, say(status, found))
        assert [r.action for r in log.collect()] == [action]
        report = compliance.report(log, 1)
        assert report.safe_harbor_compliant is fine and len(report.identifiers_addressed) == 18
    assert "| 18 |" in compliance.to_markdown(report) and not compliance.report(log, method="expert").safe_harbor_compliant


def test_audit_round_trip(spark, tmp_path):
    _, log = deidentify(frame(spark, {"id": "x", "a": "a@b.org"}), Config(date_shift_salt=SALT))
    audit.append(log, str(tmp_path / "log"))
    audit.append(log, str(tmp_path / "log"))
    back = audit.read(spark, str(tmp_path / "log"))
    assert audit.summary_dict(back) == {"total_entries": 4, "phi_removed": 2, "by_layer": {"PATTERN": 2, "DATE_SHIFT": 2}, "by_category": {"EMAIL": 2, "DATE": 2}, "by_action": {"PHI_REMOVED": 2, "DATE_SHIFTED": 2}}
    assert json.loads(audit.to_json(back, "r1"))["pipeline_run_id"] == "r1" and "a@b.org" not in audit.to_json(back)
    assert audit.render(back).where(F.col("line").startswith("[PHI Removed] EMAIL")).count() == 2


def test_trees():
    assert flatten({"a": {"b": 1, "c": [2, 3]}, "d": [], "e": [{"x": 1}], "f": None}) == {"a.b": 1, "a.c": 2, "f": None}
    assert strings({"a": ["x", {"b": "y"}], "c": 1}) == ["x", "y"]
