"""Framed readers against readers of whole files, whatever the byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark.errors import FHIRValidationError, IngestError
from veilspark.sources import fhir, framed, hl7


def split_by(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture(autouse=True)
def restore(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted((r.id, r.resource_type, r.data_json, r.source_uri) for r in df.collect())


@pytest.mark.parametrize("size", [97, 10_000_000])
def test_messages_as_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    ends = ["\r", "\n", "\r\n"]
    for k in range(2):
        parts = [rng.choice(["", "  ", "junk MSH|x\n", "\n"])] if k else [""]
        for n in range(rng.randint(4, 6)):
            e = rng.choice(ends)
            parts.append(e.join([f"MSH|^~\\&|A|B|{'x' * rng.randint(0, 30)}", f"PID|1||{k}-{n}||Doe^J MSH|not a start||19600102|M", "OBX|1|NM|g||5.5|mg", "DG1|1||E11.9^T|t é漢 MSH|"]) + e)
        (tmp_path / f"m{k}.hl7").write_bytes("".join(parts).encode())
    (tmp_path / "none.hl7").write_bytes(b"")
    whole = spark.read.text(str(tmp_path), wholetext=True).select("value", F.col("_metadata.file_path").alias("uri"))
    want = rows(hl7.message_records(whole, "value", "uri"))
    split_by(spark, size)
    got = hl7.read_hl7(spark, str(tmp_path / "*.hl7"))
    assert rows(got) == want and len(want) > 10


def bundle(rng, n):
    deep = lambda d: rng.choice(["a}b", 'q"}{[', "\\", "x" * rng.randint(0, 60), "漢}", "entry", 5, None, True] + ([{"entry": [deep(d - 1)], "k": [[deep(d - 1)], {}]}] * 4 if d else []))
    entry = [{"fullUrl": "u", "resource": {"resourceType": rng.choice(["Patient", "Observation", "Nothing"]), "id": f"r{i}", "x": deep(2)}} if i % 4 else {"resourceType": "Patient", "id": f"p{i}", "y": deep(2)} for i in range(n)]
    top = [("resourceType", "Bundle"), ("meta", {"tag": [{"resourceType": "Patient", "id": "no"}], "entry": {"a": {"id": "no"}}}), ("link", [{"url": "a}"}, {"url": "]"}]), ("entry", entry), ("after", [{"resourceType": "Patient", "id": "no"}]), ("total", n)]
    rng.shuffle(top)
    return dict(top)


@pytest.mark.parametrize("size", [151, 10_000_000])
def test_entries_as_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    for k in range(2):
        (tmp_path / f"b{k}.json").write_text(json.dumps(bundle(rng, rng.randint(3, 6)), indent=rng.choice([None, 2]), ensure_ascii=k % 2 == 0) + rng.choice(["", "\n", " \n\n"]))
    (tmp_path / "b9.json").write_text('{"resourceType":"Bundle"}')
    whole = spark.read.text(str(tmp_path), wholetext=True).select("value", F.col("_metadata.file_path").alias("uri"))
    want = rows(fhir.bundle_records(whole, "value", "uri"))
    split_by(spark, size)
    assert rows(fhir.read_bundles(spark, str(tmp_path))) == want and len(want) > 5


def test_many_tasks_read_one_file(spark, tmp_path):
    text = "".join(f"MSH|^~\\&|A\rPID|1||{n}||Doe\r" for n in range(800))
    (tmp_path / "one.hl7").write_text(text)
    split_by(spark, 2500)
    out, ranges, _ = framed.frames(spark, str(tmp_path / "one.hl7"), framed._Messages)
    assert ranges.count() >= len(text) // 2500 and sorted(r.n for r in out.collect()) == list(range(800))


@pytest.mark.parametrize("size", [30])
def test_what_is_no_bundle(spark, tmp_path, size):
    split_by(spark, size)
    for k, text in enumerate(["{not json", "hello", '{"resourceType":"Bundle","entry":[{"resourceType":"Patient"}', '{"resourceType":"Bundle","a":"x}', '{"resourceType":"Bundle","entry":[{"a":}]}\n']):
        (tmp_path / f"x{k}.json").write_text(text)
        with pytest.raises(IngestError):
            fhir.read_bundles(spark, str(tmp_path / f"x{k}.json"))
    (tmp_path / "p.json").write_text('{"text":"\\"resourceType\\":\\"Bundle\\"", "resourceType" : "Patient", "a":[{"resourceType":"Bundle"}]}')
    with pytest.raises(FHIRValidationError):
        fhir.read_bundles(spark, str(tmp_path / "p.json"))
    (tmp_path / "e.json").write_text('{"resourceType":"Bundle","entry":[]} ')
    assert fhir.read_bundles(spark, str(tmp_path / "e.json")).count() == 0
    with pytest.raises(IngestError):
        fhir.read_bundles(spark, str(tmp_path / "not there.json"))
