"""Registered queries over files and whole flows: what sources read, what sinks write, and what several operators do together."""

from __future__ import annotations

import ast
import contextlib
import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .. import cli, schema
from ..errors import KAnonymityError, ReidentificationRiskError
from ..functions import phi, trees
from ..functions.shared import folder, read_text, settle
from ..operators import audit, compliance, kanonymity, lineage, pipeline, synthesis, verify
from ..operators.deidentify import Config, deidentify, ensure_salt
from ..sources import documents as docs_source
from ..sources.fhir import FHIRSource
from ..sources.tables import read_csv
from ..streaming import events as streaming
from .catalogue import _DCR, _LOG, _RE, SALT, _log, _notes, _offset, _ops, query, t
from .standin import StandIn


def _field(path: str) -> Column:
    return F.get_json_object("data_json", path)


def _by_nation(df: DataFrame, suffix: str, text: Column) -> str:
    """Texts joined by nation, a file each, in a new folder whose name ends as such files' names do."""
    path = folder(df.sparkSession, suffix)
    rows = df.groupBy(F.col("c_nationkey").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("value"))
    rows.repartition("n").write.partitionBy("n").text(path)
    return path


# Sources and sinks


@query("""SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS pid, CASE WHEN c_custkey % 7 = 0 THEN c_name || chr(10) || '"Box" ' || c_custkey ELSE c_name END AS value FROM customer
UNION ALL SELECT 'Observation', 'Patient/' || c_custkey, c_nationkey::VARCHAR FROM customer""")
def files_csv(spark, d):
    """Tables with quoted line ends, whose format the suffix tells."""
    k, path = F.col("c_custkey").cast("string"), folder(spark, ".csv")
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit('\n"Box" '), k)).otherwise(F.col("c_name"))
    c = t(spark, d, "customer").select(k.alias("MRN"), line.alias("Address"), F.col("c_nationkey").cast("string").alias("Heart Rate"), F.lit("z").alias("unknown"))
    c.write.option("header", True).option("escape", '"').csv(path)
    r = cli.read_source(spark, path)
    return r.select("resource_type", F.coalesce(_field("$.id"), _field("$.subject.reference")).alias("pid"), F.coalesce(_field("$.address[0].line[0]"), _field("$.valueString")).alias("value"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS same FROM customer")
def csv_ids(spark, d):
    """Equal rows get ids of their own, and the same ids however files are split."""
    c = t(spark, d, "customer").select((F.col("c_custkey") % 100).cast("string").alias("patient_id"), F.lit("f").alias("sex"))
    found = []
    for parts in (1, 5):
        path = folder(spark, ".csv")
        c.repartition(parts).write.option("header", True).csv(path)
        r = read_csv(spark, path).withColumn("key", F.sha2(F.concat_ws("|", "data_json", F.row_number().over(Window.partitionBy("data_json").orderBy("data_json"))), 256))
        found.append(r.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum")).first())
    return spark.createDataFrame([(found[0]["n"], found[1]["ids"], found[0]["sum"] == found[1]["sum"])], "n long, ids long, same boolean")


@query("SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS rid FROM customer UNION ALL SELECT 'Observation', 'o' || c_custkey FROM customer")
def files_bundles(spark, d):
    """A bundle a nation, through the dispatcher for files."""
    k = F.col("c_custkey").cast("string")
    entry = F.concat(F.lit('{"resource":{"resourceType":"Patient","id":"'), k, F.lit('"}},{"resource":{"resourceType":"Observation","id":"o'), k, F.lit('"}},{"resource":{"resourceType":"Nothing"}}'))
    c, path = t(spark, d, "customer"), folder(spark, ".json")
    rows = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value"))
    rows.repartition("n").write.partitionBy("n").text(path)
    return FHIRSource(path).ingest(spark).select("resource_type", _field("$.id").alias("rid"))


@query("SELECT 'Patient' AS resource_type, s_suppkey::VARCHAR AS rid, 's' || s_suppkey AS name FROM supplier UNION ALL SELECT 'Encounter', 'n' || n_nationkey, NULL FROM nation")
def fhir_server(spark, d):
    """A server's resources of all types, in parts by time of last update. A server holds its resources itself; the stand-in holds the rows of two small tables."""
    at = lambda k: f"2024-01-{1 + k // 1440 % 28:02}T{k // 60 % 24:02}:{k % 60:02}:00.000Z"
    patients = [{"resourceType": "Patient", "id": str(r[0]), "name": f"s{r[0]}", "meta": {"lastUpdated": at(r[0])}} for r in t(spark, d, "supplier").select("s_suppkey").toLocalIterator()]
    visits = [{"resourceType": "Encounter", "id": f"n{r[0]}", "meta": {"lastUpdated": at(r[0])}} for r in t(spark, d, "nation").select("n_nationkey").toLocalIterator()]
    server = StandIn({"Patient": patients, "Encounter": visits}, spark.conf.get("spark.driver.host", "127.0.0.1"))
    try:
        source = FHIRSource(server.url, page_size=50, options={"part_rows": str(max(10, len(patients) // 4))})
        return settle(source.ingest(spark).select("resource_type", _field("$.id").alias("rid"), _field("$.name").alias("name")))
    finally:
        server.close()


@query("SELECT c_custkey::VARCHAR AS pid, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'unknown' END AS sex FROM customer")
def files_hl7(spark, d):
    """Several messages a file; the suffix tells the format."""
    k = F.col("c_custkey").cast("string")
    message = F.concat(F.lit("MSH|^~\\&|A|B|C|D|20240115||ADT^A01\rPID|1||"), k, F.lit("^^^H||Doe^Jo||19600102|"), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("U"))
    r = cli.read_source(spark, _by_nation(t(spark, d, "customer"), ".hl7", message))
    return schema.patients(r).select(_field("$.id").alias("pid"), _field("$.gender").alias("sex"))


@query("SELECT resource_type, n FROM (SELECT 'Patient' AS resource_type, count(DISTINCT c_nationkey) AS n FROM customer UNION ALL SELECT 'DocumentReference', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'Condition', 2 * count(DISTINCT c_nationkey) FROM customer)")
def files_documents(spark, d):
    """Text files through the reader of documents, a patient and two codes each."""
    path = _by_nation(t(spark, d, "customer"), "", F.lit("Patient: Jo Smith\nMRN: U77\nDiagnosis: E11.9, I10 and E11.9"))
    return docs_source.read_documents(spark, f"{path}/*/*.txt").groupBy("resource_type").agg(F.count("*").alias("n"))


_RECORDS = """(SELECT 'CSV' AS source_format, 'Patient' AS resource_type, c_custkey AS k FROM customer UNION ALL SELECT 'CSV', 'Observation', c_custkey FROM customer UNION ALL SELECT 'PDF', 'DocumentReference', n_nationkey FROM nation)"""


def _sources(d: str):
    """Two sources as functions of a session."""
    from ..sources import tables

    def table(spark):
        c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_nationkey").cast("string").alias("bmi"))
        return tables.table_records(c, ordinal=F.col("patient_id"))

    def texts(spark):
        n = t(spark, d, "nation")
        return docs_source.text_records(n.select(F.concat(F.lit("seen in "), F.lower("n_name")).alias("x"), F.col("n_nationkey").cast("string").alias("u")), "x", "u")

    return table, texts


@query(f"SELECT source_format, resource_type, count(*) AS n FROM {_RECORDS} GROUP BY ALL")
def ingest_sources(spark, d):
    return pipeline.ingest(spark, _sources(d)).groupBy("source_format", "resource_type").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (resource_type = 'Patient') AS patients, count(*) FILTER (resource_type = 'Observation') AS observations, 0::BIGINT AS conditions, 0::BIGINT AS encounters FROM {_RECORDS}")
def typed_accessors(spark, d):
    r = pipeline.ingest(spark, _sources(d))
    return spark.createDataFrame([tuple(f(r).count() for f in (schema.patients, schema.observations, schema.conditions, schema.encounters))], "patients long, observations long, conditions long, encounters long")


@query(f"SELECT resource_type, count(*) AS n, count(*) AS same FROM {_RECORDS} GROUP BY resource_type")
def dataset_json_file(spark, d):
    """One JSON file of records, written and read again: the checksum of what is read is that of what was written."""
    r = pipeline.ingest(spark, _sources(d)).withColumn("ingested_at", F.lit("2024-01-02").cast("timestamp"))
    path = folder(spark, ".json")
    cli.save(r, path)
    back = cli.load(spark, path)
    now = schema.checksum(F.col("resource_type"), F.col("data_json"), F.col("source_format"), F.col("source_uri"))
    return back.groupBy("resource_type").agg(F.count("*").alias("n"), F.count_if(F.col("checksum") == now).alias("same"))


@query(f"SELECT source_format, count(*) AS n FROM {_RECORDS} GROUP BY source_format")
def dataset_parquet_folder(spark, d):
    path = folder(spark, ".parquet")
    cli.save(pipeline.ingest(spark, _sources(d)), path)
    return cli.load(spark, path).groupBy("source_format").agg(F.count("*").alias("n"))


@query(f"SELECT seq, original_hash, category FROM {_LOG}")
def audit_json_file(spark, d):
    """An exported audit log, read back."""
    path = folder(spark, ".json")
    audit.save_json(_log(spark, d), path)
    return audit.from_json(spark, path).select(F.col("seq").cast("bigint").alias("seq"), "original_hash", "category")


@query(f"SELECT count(*) AS n, count(*) FILTER (action = 'PHI_REMOVED') AS gone FROM (SELECT * FROM {_LOG} UNION ALL SELECT * FROM {_LOG})")
def audit_appended(spark, d):
    path = folder(spark)
    for _ in range(2):
        audit.append(_log(spark, d), path)
    return audit.read(spark, path).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "PHI_REMOVED").alias("gone"))


@query("SELECT count(*) AS n, count(*) FILTER (note LIKE '%[EMAIL]%') AS emails FROM (SELECT 'mail [EMAIL]' AS note FROM customer)")
def cli_flow(spark, d):
    """The command line: a table to records, records to clean ones."""
    source, data, out = (folder(spark, x) for x in (".csv", ".parquet", ".parquet"))
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.concat(F.lit("mail u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com")).alias("diagnosis"))
    c.write.option("header", True).csv(source)
    codes = [cli.main(["ingest", source, "--out", data]), cli.main(["deidentify", data, "--out", out, "--salt", SALT])]
    clean = schema.conditions(cli.load(spark, out)).where(F.lit(codes == [0, 0]))
    return clean.agg(F.count("*").alias("n"), F.count_if(F.contains(_field("$.code.display"), F.lit("[EMAIL]"))).alias("emails"))


# Records


def _nested(spark, d) -> DataFrame:
    """Records with objects, lists and numbers."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    j = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.struct(k.alias("no"), F.struct(F.col("c_mktsegment").alias("of")).alias("in")).alias("deep"), F.array(F.lit("first"), F.lit("second")).alias("tags"),
        F.array(F.struct(F.lit("x").alias("y"))).alias("rows"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("some"),
    ))
    return c.select(k.alias("c_custkey"), F.lit("Patient").alias("resource_type"), j.alias("data_json"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment || '|first|second|x' AS said FROM customer")
def string_collect(spark, d):
    @pandas_udf("string")
    def said(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "|".join(trees.strings(json.loads(x))))

    return _nested(spark, d).select("c_custkey", said("data_json").alias("said"))


@query("SELECT resource_type, name, c_custkey::DOUBLE AS no, c_mktsegment AS seg, 'first' AS tag, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::DOUBLE END AS some FROM (SELECT 'Patient' AS resource_type, c_name AS name, * FROM customer)")
def flattened_table(spark, d):
    """Records as a table: dotted keys, numbers apart from text, the first of a list."""
    table = synthesis.table_of(_nested(spark, d))
    return table.select("resource_type", "name", F.col("`deep.no`").alias("no"), F.col("`deep.in.of`").alias("seg"), F.col("tags").alias("tag"), "some")


@query("SELECT unnest(['deep.in.of', 'deep.no', 'name', 'some', 'tags']) AS key, unnest(['text', 'number', 'text', 'number', 'text']) AS kind")
def column_kinds(spark, d):
    return spark.createDataFrame(synthesis.columns_of(_nested(spark, d)), "key string, kind string")


# De-identification


@query("SELECT c_custkey, 'ZIP_CODE EMAIL PHONE' AS categories, '[ZIP] a, [EMAIL] or [PHONE]!' AS redacted FROM customer")
def span_order(spark, d):
    """All rules over one text: matches by where they start, and the text without them."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("62704 a, u"), k, F.lit("@mail.example.com or 555-123-4567!"))

    found = t(spark, d, "customer").select("c_custkey", text.alias("text")).withColumn("found", phi.spans(F.col("text")))
    categories = F.transform(phi.matches(F.col("found")), lambda m: m["category"])
    return found.select("c_custkey", F.array_join(categories, " ").alias("categories"), phi.redacted(F.col("text"), F.col("found")).alias("redacted"))


@query("SELECT c_custkey::VARCHAR AS pid, 'badge [BADGE] of a guest' AS note FROM customer")
def extra_patterns(spark, d):
    k = F.col("c_custkey").cast("string")
    j = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("badge B-"), k, F.lit(" of a guest")).alias("note")))
    r = t(spark, d, "customer").select(k.alias("id"), F.lit("Patient").alias("resource_type"), j.alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("").alias("checksum"))
    clean, _ = deidentify(r, Config(date_shift=False, extra_patterns=(("badge", r"B-\d+"),)))
    return clean.select(F.col("id").alias("pid"), _field("$.note").alias("note"))


def _dated(spark, d) -> DataFrame:
    k = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    j = F.to_json(F.struct(k.alias("id"), F.lit("3/4/1960").alias("birthDate"), F.lit("no day in here").alias("note"), F.lit("x 20010203 y").alias("text")))
    return t(spark, d, "customer").select(k.alias("id"), F.lit("Patient").alias("resource_type"), j.alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("").alias("checksum"))


@query(f"SELECT k AS pid, strftime(DATE '1960-03-04' + {_offset('k')}, '%m/%d/%Y') AS born, 'x ' || strftime(DATE '2001-02-03' + {_offset('k')}, '%Y%m%d') || ' y' AS text FROM (SELECT 'p' || c_custkey AS k FROM customer)")
def whole_value_dates(spark, d):
    """A value that is a date as a whole may be written leniently."""
    clean, _ = deidentify(_dated(spark, d), Config(date_shift_salt=SALT))
    return clean.select(F.col("id").alias("pid"), _field("$.birthDate").alias("born"), _field("$.text").alias("text"))


@query("SELECT true AS made, true AS kept, true AS none")
def salt_of_a_run(spark, d):
    made, given, none = ensure_salt(Config()), ensure_salt(Config(date_shift_salt="s")), ensure_salt(Config(date_shift=False))
    return spark.createDataFrame([(len(made.date_shift_salt) >= 32 and made != ensure_salt(Config()), given.date_shift_salt == "s", none.date_shift_salt == "")], "made boolean, kept boolean, none boolean")


@query("SELECT 'p' || c_custkey AS pid, true AS within, true AS same_shift FROM customer")
def salted_by_default(spark, d):
    """Without a salt of its own a run gets one: all dates of a record move by one offset of at most a year, and the next run's offsets are others."""
    runs = [deidentify(_dated(spark, d), ensure_salt(Config()))[0].select(F.col("id").alias("pid"), *[F.datediff(F.try_to_date(v, f), F.lit(was).cast("date")).alias(f"{c}{k}") for c, v, f, was in
            (("a", _field("$.birthDate"), "MM/dd/yyyy", "1960-03-04"), ("b", F.substring(_field("$.text"), 3, 8), "yyyyMMdd", "2001-02-03"))]) for k in range(2)]
    both = settle(runs[0].join(runs[1], "pid"))
    if not both.where("a0 <> a1").limit(1).count() and both.limit(1).count():
        raise AssertionError("two runs have one salt")
    return both.select("pid", (F.greatest(F.abs("a0"), F.abs("a1")) <= 365).alias("within"), ((F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))).alias("same_shift"))


@query("SELECT 'r' || c_custkey AS record_id, 'plain words' AS note, 'shifted_dates=0' AS said FROM customer")
def clean_records_pass(spark, d):
    """Records without digits, cues or rules' words keep their text; the audit says that no date was moved."""
    r = t(spark, d, "customer").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Observation").alias("resource_type"), F.lit('{"note":"plain words"}').alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("").alias("checksum"))
    clean, log = deidentify(r, Config(date_shift_salt=SALT), once=True)
    return clean.join(log, clean["id"] == log["record_id"]).select("record_id", _field("$.note").alias("note"), F.col("replacement").alias("said"))


def _answer(url: str, headers: dict, body: dict, timeout: float) -> dict:
    """What a service might say: prose round an array, an empty array, or no JSON at all."""
    text = body["messages"][-1]["content"]
    if "u1@" in text or "broken" in text:
        return {"content": [{"text": "so [not json]"}]}
    said = 'Found: [{"text": "Roe", "category": "PATIENT_NAME", "confidence": 0.9}, 7] as asked.' if "left" in text else "[]"
    return {"content": [{"text": said}]}


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'PHI_VERIFIED_CLEAN' WHEN 1 THEN 'PHI_DETECTED_LLM' ELSE 'PHI_VERIFICATION_ERROR' END AS action, CASE c_custkey % 3 WHEN 1 THEN 'PATIENT_NAME' ELSE 'NONE' END AS category,
CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS n FROM customer GROUP BY ALL""")
def llm_verified(spark, d):
    """The verification layer with a stand-in for the service."""
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, "all gone").when(k % 3 == 1, "Roe is left").otherwise("broken")
    r = t(spark, d, "customer").select(k.cast("string").alias("id"), F.lit("Patient").alias("resource_type"), F.to_json(F.struct(note.alias("note"))).alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("u").alias("source_uri"), F.lit("").alias("checksum"))
    _, log = deidentify(r, Config(date_shift=False, llm_verification=True, verifier=verify.verifier("anthropic", "a-model", "https://llm.example.org", "key", send=_answer)))
    return log.groupBy("action", "category", "confidence").agg(F.count("*").alias("n"))


@query("SELECT 'anthropic' AS provider, 'https://x.example.org/v1/messages' AS url, 'Roe' AS found UNION ALL SELECT 'openai', 'https://x.example.org/v1/chat/completions', 'Roe'")
def llm_request_and_reply(spark, d):
    replies = {"anthropic": {"content": [{"text": '[{"text": "Roe"}]'}]}, "openai": {"choices": [{"message": {"content": 'x [{"text": "Roe"}] y'}}]}}
    rows = [(p, verify.request("a text", p, "m", "k", "https://x.example.org/")[0], verify.findings(verify.reply_text(p, r))[0]["text"]) for p, r in replies.items()]
    return spark.createDataFrame(rows, "provider string, url string, found string")


@query("SELECT c_custkey::VARCHAR AS record_id, 'PHI_VERIFICATION_SKIPPED' AS action, 'no verifier' AS replacement FROM customer")
def llm_skipped(spark, d):
    _, log = deidentify(_notes(spark, d), Config(date_shift=False, llm_verification=True))
    return audit.filtered(log, layer="LLM_VERIFY").select("record_id", "action", "replacement")


# Audit, compliance, lineage

_ACTIONS = ("PHI_REMOVED", "DATE_SHIFTED", "PHI_VERIFIED_CLEAN", "PHI_DETECTED_LLM", "PHI_VERIFICATION_SKIPPED", "PHI_VERIFICATION_ERROR", "OTHER")


@query("""SELECT n_nationkey::INTEGER AS seq, CASE n_nationkey % 7
WHEN 0 THEN '[PHI Removed] SSN "' || substr(sha256(n_name), 1, 16) || '" -> "[R]" (L, confidence: 0.50)' WHEN 1 THEN '[Date Shifted] [R] (L)' WHEN 2 THEN '[PHI Verified] LLM found no additional PII in free-text fields'
WHEN 3 THEN '[PHI Detected] LLM found: ' || substr(sha256(n_name), 1, 16) || ' (SSN, confidence: 0.50)' WHEN 4 THEN '[PHI Verification Skipped] LLM verification was not run ([R])'
WHEN 5 THEN '[PHI Verification Error] LLM verification failed ([R])' ELSE '[OTHER] SSN: [R] (L)' END AS line FROM nation""")
def audit_lines(spark, d):
    """Every form of an entry's line."""
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    n = t(spark, d, "nation").select(F.lit("r").alias("record_id"), F.col("n_nationkey").cast("int").alias("seq"), action.alias("action"), F.lit("L").alias("layer"), F.col("n_name").alias("original"), F.lit("[R]").alias("replacement"), F.lit("SSN").alias("category"), F.lit(0.5).alias("confidence"))
    return audit.render(audit.entries(n)).select("seq", "line")


@query(f"""SELECT true AS compliant, count(*) AS entries, count(*) FILTER (action = 'PHI_REMOVED') AS phi_removed, 5 AS addressed, 7::BIGINT AS records, true AS asks_for_review, true AS says_not_enabled, true AS same_in_file FROM {_LOG}""")
def compliance_report(spark, d):
    """A report: five categories cover five identifiers; three of the others need a person."""
    r = compliance.report(_log(spark, d), 7)
    path = folder(spark, ".json")
    compliance.save_json(r, path)
    saved, text = json.loads(read_text(path)), compliance.to_markdown(r)
    row = (r.safe_harbor_compliant, r.audit_summary["total_entries"], r.phi_removed_count, sum(r.identifiers_addressed.values()), r.record_count, sum("MANUAL REVIEW" in n for n in r.notes) == 3, any("was not enabled" in n for n in r.notes))
    same = saved["phi_removed_count"] == r.phi_removed_count and f"**PHI items removed:** {r.phi_removed_count}" in text
    return spark.createDataFrame([(*row, same)], "compliant boolean, entries long, phi_removed long, addressed int, records long, asks_for_review boolean, says_not_enabled boolean, same_in_file boolean")


@query("SELECT unnest(['clean', 'found', 'skipped']) AS run, unnest([true, false, false]) AS compliant, unnest(['completed', 'detected', 'did not complete']) AS note")
def compliance_of_verification(spark, d):
    rows = []
    for run, action in (("clean", "PHI_VERIFIED_CLEAN"), ("found", "PHI_DETECTED_LLM"), ("skipped", "PHI_VERIFICATION_SKIPPED")):
        log = audit.entries(t(spark, d, "region").select(F.col("r_name").alias("record_id"), F.lit(action).alias("action"), F.lit("LLM_VERIFY").alias("layer"), F.lit("").alias("original"), F.lit("").alias("replacement"), F.lit("NONE").alias("category"), F.lit(1.0).alias("confidence")))
        r = compliance.report(log)
        rows.append((run, r.safe_harbor_compliant, next(w for w in ("completed", "detected", "did not complete") if any(f"LLM verification {w}" in n for n in r.notes))))
    return spark.createDataFrame(rows, "run string, compliant boolean, note string")


_FIRST = "(SELECT min(o_custkey) FROM orders)"


def _first(spark, d) -> str:
    return str(t(spark, d, "orders").agg(F.min("o_custkey")).first()[0])


@query(f"SELECT o_orderkey::VARCHAR AS node_id FROM orders WHERE o_custkey = {_FIRST}")
def lineage_history(spark, d):
    return lineage.history(_ops(spark, d), _first(spark, d)).select("node_id")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey)::INTEGER AS step, o_orderkey::VARCHAR AS node_id FROM orders WHERE o_custkey = {_FIRST}")
def lineage_path(spark, d):
    """The trace of a record's last node, from its source."""
    nodes = lineage.linked(_ops(spark, d).where(F.col("record_id") == _first(spark, d)))
    last = nodes.orderBy(F.desc("seq")).first()["node_id"]
    assert lineage.node(nodes, last)["node_id"] == last
    return spark.createDataFrame(list(enumerate(lineage.trace(nodes, last), 1)), "step int, node_id string")


@query(f"SELECT o_orderkey::VARCHAR AS node_id, (row_number() OVER (ORDER BY o_orderkey) > 1)::INTEGER AS n_parents, count(*) OVER () AS of_record FROM orders WHERE o_custkey = {_FIRST}")
def lineage_export(spark, d):
    """The graph as plain data; each node's parents by the operator."""
    nodes = lineage.linked(_ops(spark, d).where(F.col("record_id") == _first(spark, d)))
    out = lineage.to_dict(nodes)
    rows = [(k, lineage.parents(nodes, k).count(), len(out["records"][v["record_id"]])) for k, v in out["nodes"].items()]
    return spark.createDataFrame(rows, "node_id string, n_parents int, of_record long")


@query("""SELECT 'raw' AS part, 2 * count(*) + (SELECT count(*) FROM nation) AS n FROM customer UNION ALL SELECT 'clean', 2 * count(*) + (SELECT count(*) FROM nation) FROM customer
UNION ALL SELECT 'dates', 2 * count(*) + (SELECT count(*) FROM nation) FROM customer UNION ALL SELECT 'ingest', 2 * count(*) + (SELECT count(*) FROM nation) FROM customer
UNION ALL SELECT 'deidentify', 2 * count(*) + (SELECT count(*) FROM nation) FROM customer""")
def pipeline_run(spark, d):
    """The whole flow: every record is read, cleaned, audited, and has two linked nodes."""
    r = pipeline.run(spark, _sources(d), pipeline.PipelineConfig(deid=Config(date_shift_salt=SALT)))
    one = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    step = lambda name: r.lineage.where((F.col("operation") == name) & (F.size("parent_ids") == int(name != "ingest")))
    parts = [one("raw", r.raw), one("clean", r.clean), one("dates", audit.filtered(r.audit, action="DATE_SHIFTED")), one("ingest", step("ingest")), one("deidentify", step("deidentify"))]
    return schema.merge(parts, spark)


# Privacy and synthesis


@query("SELECT k, (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) >= k AS holds FROM (VALUES (2), (1000), (1000000000)) v(k)")
def kanon_check(spark, d):
    rows = []
    for k in (2, 1000, 1_000_000_000):
        try:
            rows.append((k, kanonymity.check(t(spark, d, "orders"), ["o_orderstatus"], k)))
        except KAnonymityError:
            rows.append((k, False))
    return spark.createDataFrame(rows, "k int, holds boolean")


@query("SELECT n_nationkey AS k, round((2 + n_nationkey / 10) / 2, 6) AS own, round((2 + n_nationkey / 10) / 2, 6) AS other FROM nation WHERE n_nationkey > 0")
def nearest_psd(spark, d):
    """The nearest positive matrix of [[1, x], [x, 1]] with x above one has (1 + x) / 2 everywhere."""
    rows = []
    for (k,) in t(spark, d, "nation").where("n_nationkey > 0").select("n_nationkey").collect():
        m = synthesis.nearest_psd(np.array([[1, 1 + k / 10], [1 + k / 10, 1]]))
        rows.append((k, round(float(m[0, 0]), 6), round(float(m[0, 1]), 6)))
    return spark.createDataFrame(rows, "k int, own double, other double")


@query("""WITH a AS (SELECT avg(c_acctbal) m1, stddev_samp(c_acctbal) s1, avg(c_nationkey) m2, stddev_samp(c_nationkey) s2, corr(c_acctbal, c_nationkey) r FROM customer),
b AS (SELECT avg(s_acctbal) m1, stddev_samp(s_acctbal) s1, avg(s_nationkey) m2, stddev_samp(s_nationkey) s2, corr(s_acctbal, s_nationkey) r FROM supplier),
u AS (SELECT c_acctbal a, c_nationkey b FROM customer UNION ALL SELECT s_acctbal, s_nationkey FROM supplier), g AS (SELECT max(a) - min(a) ra, max(b) - min(b) rb FROM u),
d AS (SELECT s_suppkey, min(sqrt(((s_acctbal - c_acctbal) / ra) ** 2 + ((s_nationkey - c_nationkey) / rb::DOUBLE) ** 2)) AS dcr FROM supplier, customer, g GROUP BY s_suppkey),
f AS (SELECT 1 - least(abs(x - y) / greatest(abs(x), abs(y), 1e-8), 1) AS near FROM (SELECT a.m1 x, b.m1 y FROM a, b UNION ALL SELECT a.s1, b.s1 FROM a, b UNION ALL SELECT a.m2, b.m2 FROM a, b UNION ALL SELECT a.s2, b.s2 FROM a, b))
SELECT round((SELECT avg(near) FROM f), 6) AS fidelity, round((SELECT 1 - least(sqrt(2 * (a.r - b.r) ** 2) / (sqrt(2 + 2 * a.r ** 2) + 1e-8), 1) FROM a, b), 6) AS ml_utility,
round((SELECT avg((dcr = 0)::INTEGER) + greatest(0, 1 - avg(dcr)) * 0.01 FROM d), 6) AS reidentification_risk""")
def utility_of_tables(spark, d):
    real = t(spark, d, "customer").select(*_DCR)
    other = t(spark, d, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("not_common"))
    u = synthesis.evaluate(real, other)
    return spark.createDataFrame([tuple(round(x, 6) for x in (u.fidelity, u.ml_utility, u.reidentification_risk))], "fidelity double, ml_utility double, reidentification_risk double")


@query("SELECT unnest(['copies', 'close', 'far']) AS rows, unnest([false, false, true]) AS passed")
def risk_validation(spark, d):
    real, out = t(spark, d, "customer").select("c_acctbal"), []
    for name, rows in (("copies", real), ("close", real.select((F.col("c_acctbal") + 0.001).alias("c_acctbal"))), ("far", spark.createDataFrame([(1e9,)], "c_acctbal double"))):
        try:
            out.append((name, synthesis.validate(real, rows).passed))
        except ReidentificationRiskError:
            out.append((name, False))
    return spark.createDataFrame(out, "rows string, passed boolean")


@query("SELECT 500::BIGINT AS n, 1::BIGINT AS formats, 500::BIGINT AS ids, true AS near_mean, 5::BIGINT AS kinds")
def synthesized_records(spark, d):
    """Synthetic records of a seed: as many as asked for, ids of their own, the mean near the real one, all five segments."""
    j = F.to_json(F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment")))
    real = t(spark, d, "customer").select(F.lit("Patient").alias("resource_type"), j.alias("data_json"))
    out = synthesis.synthesize(real, 500, seed=3, check=False)
    mean = real.agg(F.avg(_field("$.balance").cast("double")), F.stddev(_field("$.balance").cast("double"))).first()
    near = F.abs(F.avg(_field("$.balance").cast("double")) - mean[0]) < 5 * mean[1] / 500**0.5
    return out.agg(F.count("*").alias("n"), F.count_distinct("source_format").alias("formats"), F.count_distinct("id").alias("ids"), near.alias("near_mean"), F.count_distinct(_field("$.segment")).alias("kinds"))


def _accounts(spark, d) -> DataFrame:
    j = F.to_json(F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return schema.records(t(spark, d, "customer"), F.lit("Patient"), j, "CSV", F.lit("u"), F.col("c_custkey"))


@query("SELECT 0 AS code, 200::BIGINT AS n, true AS inside, count(DISTINCT c_mktsegment) AS segments FROM customer")
def cli_synthesize(spark, d):
    """The command line's synthesize: as many records as asked for, numbers inside the real ones' range, all segments."""
    real, out = folder(spark), folder(spark)
    cli.save(_accounts(spark, d), real)
    code = cli.main(["synthesize", real, "--out", out, "-n", "200", "--seed", "4", "--no-check"])
    ends = t(spark, d, "customer").agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    inside = F.min(_field("$.balance").cast("double").between(*ends))
    return cli.load(spark, out).agg(F.lit(code).alias("code"), F.count("*").alias("n"), inside.alias("inside"), F.count_distinct(_field("$.segment")).alias("segments"))


@query(f"SELECT 0 AS code, count(*) AS total, count(*) FILTER (action = 'PHI_REMOVED') AS removed, count(DISTINCT category) AS categories FROM {_LOG}")
def cli_audit(spark, d):
    """The command line's audit of a saved log, in all three formats."""
    path, said, codes = folder(spark), {}, []
    audit.append(_log(spark, d), path)
    for form in ("summary", "markdown"):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            codes.append(cli.main(["audit", path, "--format", form]))
        said[form] = out.getvalue()
    total, removed = (int(re.search(rf"{what}: (\d+)", said["summary"])[1]) for what in ("Total entries", "PHI removed"))
    if f"**PHI items removed:** {removed}" not in said["markdown"]:
        raise AssertionError("the formats do not agree")
    categories = len(ast.literal_eval(re.search(r"By category: (.*)", said["summary"])[1]))
    return spark.createDataFrame([(max(codes), total, removed, categories)], "code int, total long, removed long, categories long")


@query("SELECT true AS refused, true AS tells_how_many, count(DISTINCT c_custkey) AS real_rows FROM customer")
def synthesis_checked(spark, d):
    """Synthesis with its check refuses rows that lie too close to real ones, as most do among two columns of numbers."""
    real, said = _accounts(spark, d), ""
    try:
        synthesis.synthesize(real, 50, seed=3)
    except ReidentificationRiskError as e:
        said = str(e)
    return real.agg(F.lit(bool(said)).alias("refused"), F.lit(bool(re.match(r"\d", said))).alias("tells_how_many"), F.count("*").alias("real_rows"))


# Streams: the same stateless and windowed operators over tables


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return streaming.windowed_counts(t(spark, d, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


_REDACTED = "text"
for _c in ("EMAIL", "PHONE", "IP_ADDRESS", "URL"):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_RE[_c]}', '{phi.BY_CATEGORY[_c][0]}', 'g')"


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256 FROM documents WHERE text IS NOT NULL")
def stream_redacted(spark, d):
    return streaming.redacted(t(spark, d, "documents").where("text is not null"), "text").select("doc_id", F.sha2("text", 256).alias("redacted_sha256"))
