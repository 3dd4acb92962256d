import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from veilspark.errors import IngestError
from veilspark.plans.standin import StandIn
from veilspark.schema import RESOURCE_TYPES
from veilspark.sources.fhir import Auth, FHIRSource
from veilspark.sources.fhir_server import Client, Range, plan


def at(k):
    return f"2024-03-{1 + k // 1440:02}T{k // 60 % 24:02}:{k % 60:02}:00.000Z"


def patients(n, step=7):
    return [{"resourceType": "Patient", "id": f"p{k}", "meta": {"lastUpdated": at(k * step)}} for k in range(n)]


@pytest.fixture
def server():
    made = []

    def start(*args, **more):
        made.append(StandIn(*args, **more))
        return made[-1]

    yield start
    for s in made:
        s.close()


def ids(df):
    return sorted(json.loads(r.data_json)["id"] for r in df.collect())


def test_all_types_in_several_parts(spark, server):
    s = server({"Patient": patients(90), "Immunization": [{"resourceType": "Immunization", "id": "i", "meta": {"lastUpdated": at(5)}}]})
    source = FHIRSource(s.url, Auth("secret"), page_size=4, options={"part_rows": "20"})
    assert source.resource_types == RESOURCE_TYPES
    df = source.ingest(spark)
    assert df.rdd.getNumPartitions() >= 6
    assert ids(df) == sorted(["i", *(f"p{k}" for k in range(90))])
    assert {t for _, t in s.requests} == {"Bearer secret"}
    # Ids do not depend on the plan.
    assert sorted(r.id for r in df.collect()) == sorted(r.id for r in FHIRSource(s.url, page_size=50).ingest(spark).collect())


def test_plan_leaves_no_gap(server):
    same = [{"id": f"s{k}", "meta": {"lastUpdated": at(100)}} for k in range(30)]
    s = server({"Patient": patients(50) + same})
    parts = plan(Client({"url": s.url}), ["Patient"], part_rows=10)
    assert parts[0].start == "" and parts[-1].upto == "" and all(a.upto == b.start for a, b in zip(parts, parts[1:], strict=False))
    client = Client({"url": s.url})
    counts = [client.total(p) for p in parts]
    assert sum(counts) == 80 and all(c <= 10 for c in counts if c < 30)
    assert len(plan(client, ["Patient"], part_rows=1, most_parts=4)) <= 9
    assert plan(client, ["Observation"]) == [] and plan(client, ["Patient"], part_rows=80) == [Range("Patient")]


def test_server_that_counts_no_ranges(spark, server):
    s = server({"Patient": patients(30)})
    whole = s.answer
    s.answer = lambda path, token: (200, {}, {"resourceType": "Bundle", "total": 30 if "_lastUpdated" not in path else 0}) if "_summary" in path else whole(path, token)
    assert plan(Client({"url": s.url}), ["Patient"], part_rows=10) == [Range("Patient")]


def test_retries(spark, server):
    s = server({"Patient": patients(12)}, fail=503)
    assert len(ids(FHIRSource(s.url, page_size=5, resource_types=("Patient",)).ingest(spark))) == 12
    s = server({"Patient": patients(1)}, fail=404)
    with pytest.raises(IngestError):
        Client({"url": s.url}).get(f"{s.url}/Patient")
    with pytest.raises(IngestError):
        Client({"url": "http://127.0.0.1:9", "retries": "1", "wait": "0.01"}).get("http://127.0.0.1:9/Patient")


def test_token_stays_with_its_host(server):
    other = server({"Patient": patients(3)})
    s = server({"Patient": patients(2)})
    whole = s.answer
    s.answer = lambda path, token: (*whole(path, token)[:2], {"entry": [{"resource": {"id": "first"}}], "link": [{"relation": "next", "url": f"{other.url}/Patient?_count=9"}]})
    assert len(list(Client({"url": s.url, "token": "t"}).pages(Range("Patient")))) == 4
    assert s.requests[0][1] == "Bearer t" and other.requests == [("/Patient?_count=9", None)]

    class Away(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(302)
            self.send_header("Location", f"{other.url}/Patient?_count=1")
            self.end_headers()

        def log_message(self, *a):
            pass

    away = HTTPServer(("127.0.0.1", 0), Away)
    threading.Thread(target=away.serve_forever, daemon=True).start()
    assert Client({"url": f"http://127.0.0.1:{away.server_port}", "token": "t"}).get(f"http://127.0.0.1:{away.server_port}/x")["entry"]
    assert other.requests[-1] == ("/Patient?_count=1", None)
    away.shutdown()


def test_stream_keeps_its_place(spark, server, tmp_path):
    s = server({"Patient": patients(20)})
    source = FHIRSource(s.url, page_size=6, resource_types=("Patient",), options={"part_rows": "8"})

    def run():
        q = source.stream(spark).select("data_json").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination(60)
        q.stop()
        return ids(spark.read.parquet(str(tmp_path / "out")))

    assert run() == sorted(f"p{k}" for k in range(20))
    s.resources["Patient"] += [{"resourceType": "Patient", "id": "new", "meta": {"lastUpdated": at(5000)}}]
    assert run() == sorted(["new", *(f"p{k}" for k in range(20))])
