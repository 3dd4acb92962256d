import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from veilspark import cli, schema
from veilspark.errors import FHIRValidationError, IngestError, UnsupportedFormatError, VeilError
from veilspark.sources.documents import read_documents
from veilspark.sources import tables
from veilspark.sources.fhir import FHIRSource, read_bundles
from veilspark.sources.hl7 import read_hl7
from veilspark.sources.tables import read_csv


def data(df):
    return [(r.resource_type, json.loads(r.data_json)) for r in df.collect()]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", "patient_id,First Name,last_name,DOB,glucose,diagnosis,phone,other\n1,Ann,Lee,1960-01-02,110,E11.9,555,zz\n2,,,,,,,\n,,,,90,,,\n3,Bo\n")
    got = data(read_csv(spark, p))
    assert [t for t, _ in got] == ["Patient", "Observation", "Condition", "Patient", "Observation", "Patient"]
    assert got[0][1] == {"resourceType": "Patient", "id": "1", "name": [{"given": ["Ann"], "family": "Lee"}], "birthDate": "1960-01-02", "telecom": [{"system": "phone", "value": "555"}]}
    assert got[1][1] == {"resourceType": "Observation", "code": {"display": "glucose"}, "valueString": "110", "subject": {"reference": "Patient/1"}}
    assert got[4][1]["subject"] == {"reference": "Patient/"} and got[5][1]["name"] == [{"given": ["Bo"]}]
    assert read_csv(spark, write(tmp_path / "b.csv", "foo,bar\n1,2\n")).count() == 0
    assert read_csv(spark, write(tmp_path / "c.csv", "patient_id,glucose\n")).count() == 0
    assert read_csv(spark, write(tmp_path / "d.csv", "pid\tfname\n7\tZed\n"), {"pid": "id", "fname": "name.given"}, delimiter="\t").count() == 1
    with pytest.raises(IngestError):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_fhir(spark, tmp_path):
    entries = [{"resource": {"resourceType": "Patient", "id": "p"}}, {"resourceType": "Observation", "id": "o"}, {"resource": {"resourceType": "Odd"}}, {"resource": {"id": "q"}}]
    p = write(tmp_path / "b.json", json.dumps({"resourceType": "Bundle", "entry": entries}))
    assert [(t, d["id"]) for t, d in data(FHIRSource(p).ingest(spark))] == [("Patient", "p"), ("Observation", "o")]
    with pytest.raises(FHIRValidationError):
        read_bundles(spark, write(tmp_path / "c.json", '{"resourceType":"Patient"}'))
    with pytest.raises(IngestError):
        read_bundles(spark, write(tmp_path / "d.json", "{not json"))


def test_fhir_server(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            kind = self.path.strip("/").split("?")[0].split("/")[0]
            first = "page=2" not in self.path
            page = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": kind, "id": f"{kind}{1 if first else 2}"}}], "link": [{"relation": "next", "url": f"{kind}?page=2"}] if first else []}
            self.send_response(200 if self.headers.get("Authorization") == "Bearer t" else 403)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    source = FHIRSource(f"http://127.0.0.1:{server.server_port}", resource_types=("Patient", "Observation", "Nonsense"))
    source.auth.token = "t"
    assert sorted(d["id"] for _, d in data(source.ingest(spark))) == ["Observation1", "Observation2", "Patient1", "Patient2"]
    server.shutdown()


def test_hl7(spark, tmp_path):
    one = "MSH|^~\\&|A|B|C|D|20250101||ADT^A01\rPID|1||77^^^X||Doe^Jane||19850315|F|||1 St^^Town^ST^12345||555\rOBX|1|NM|2345-7^Glucose||110|mg/dL||||||||20240115103000\rDG1|1||E11.9^Type 2^I10|Type 2 Diabetes||W"
    p = write(tmp_path / "a.hl7", one + "\n" + one.replace("|77^", "|78^").replace("|F|", "|U|"))
    got = data(read_hl7(spark, p))
    assert [t for t, _ in got] == ["Patient", "Observation", "Condition"] * 2
    assert (got[0][1]["id"], got[0][1]["birthDate"], got[0][1]["gender"], got[3][1]["gender"]) == ("77", "1985-03-15", "female", "unknown")
    assert got[0][1]["address"] == [{"line": ["1 St"], "city": "Town", "state": "ST", "postalCode": "12345"}]
    assert got[1][1]["effectiveDateTime"] == "2024-01-15T10:30:00" and got[1][1]["valueQuantity"] == {"value": "110", "unit": "mg/dL"} and got[2][1]["category"] == "W"
    assert "birthDate" not in data(read_hl7(spark, p, compat_null_dates=True))[0][1]
    assert read_hl7(spark, str(tmp_path / "*.none")).count() == 0


def test_documents(spark, tmp_path):
    write(tmp_path / "a.pdf", "Patient: John Smith\nDOB: 03/15/1985\nMRN: U12345\nDiagnosis: E11.9, I10 and E11.9")
    got = data(read_documents(spark, str(tmp_path / "*.pdf")))
    assert [t for t, _ in got] == ["Patient", "Condition", "Condition", "DocumentReference"]
    assert got[0][1]["id"] == "U12345" and got[0][1]["birthDate"] == "03/15/1985"
    with pytest.raises(IngestError):
        read_documents(spark, str(tmp_path / "none*.pdf"))


def test_records(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Patient", '{"a":{"b":1,"c":[{"d":1}]},"e":"","f":0}'), ("Odd", "{}")], "t string, j string")
    r = schema.records(df, F.col("t"), F.col("j"), "X", F.lit("u"))
    j = F.col("data_json")
    row = r.select(schema.path(j, "a.b"), schema.path(j, "a.c.d"), schema.path(j, ""), schema.present(schema.path(j, "e")), schema.present(schema.path(j, "f")), F.length("checksum")).first()
    assert r.count() == 1 and tuple(row) == ("1", None, None, False, True, 64)
    assert schema.merge([r, r], spark).count() == 2 and schema.patients(r).count() == 1 and schema.conditions(r).count() == 0 and list(schema.to_dicts(r))[0]["f"] == 0


def test_cli(spark, tmp_path, capsys):
    p = write(tmp_path / "a.csv", "patient_id,email\n1,a@b.org\n2,c@d.org\n")
    out = lambda n: str(tmp_path / n)
    assert cli.main(["ingest", p, "--out", out("raw")]) == 0
    assert cli.main(["deidentify", out("raw"), "--out", out("clean.json"), "--audit", out("log")]) == 0
    assert cli.main(["synthesize", out("clean.json"), "--out", out("syn"), "-n", "5"]) == 0
    for f in ("summary", "json", "markdown"):
        assert cli.main(["audit", out("log"), "--format", f]) == 0
    assert "EMAIL" in capsys.readouterr().out and "a@b.org" not in str(cli.load(spark, out("clean.json")).collect())
    assert cli.main(["ingest", write(tmp_path / "a.xyz", ""), "--out", out("x")]) == 1


def test_errors():
    assert issubclass(UnsupportedFormatError, IngestError) and issubclass(IngestError, VeilError) and VeilError("x", detail="y").detail == "y"


def test_equal_rows_of_a_table(spark, tmp_path):
    """Equal rows are records each, with ids of their own that do not depend on how the file is split, also where one row fills most of the table."""
    p = write(tmp_path / "c.csv", "patient_id,sex\n" + "1,f\n" * 500 + "".join(f"{k},m\n" for k in range(50)) + ",\n" * 300)
    found = [sorted(r.id for r in read_csv(spark, p).collect())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 400)
    try:
        found.append(sorted(r.id for r in read_csv(spark, p).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) == 550
    df = spark.createDataFrame([("a", 1)] * 7 + [("b", 2)], "x string, __h long")
    rows = tables._copies(df, df.groupBy("__h").count().where("count > 1").withColumnRenamed("count", "__c"), part=3).collect()
    assert sorted(r["__n"] for r in rows) == list(range(7)) and {r.x for r in rows} == {"a"}
