"""Registered queries: each applies an operator to the driver's tables, with the same thing in SQL where SQL can say it.

Roles: customer is Patient, orders is Encounter, lineitem and events are Observation, documents is DocumentReference.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BudgetExhaustedError
from ..functions import dates, names, phi
from ..functions.shared import folder, settle
from ..operators import audit, compliance, kanonymity, ledger, lineage, private_stats, synthesis
from ..operators.deidentify import Config, deidentify
from .. import schema
from ..schema import checksum, path
from ..sources import documents as docs_source
from ..sources import fhir, hl7, tables

SALT = "catalogue-salt"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _offset(id_sql: str) -> str:
    return f"(-365 + ('0x' || substr(sha256('{SALT}:' || {id_sql}::VARCHAR), 1, 8))::BIGINT % 731)::INTEGER"


# Date shifting


@query(f"SELECT c_custkey, {_offset('c_custkey')} AS days FROM customer")
def date_shift_offset(spark, d):
    return t(spark, d, "customer").select("c_custkey", dates.offset(F.col("c_custkey"), SALT).alias("days"))


@query(f"SELECT o_orderkey, o_custkey, strftime(o_orderdate::DATE + {_offset('o_custkey')}, '%Y-%m-%d') AS shifted FROM orders")
def date_shift_orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", day(dates.shift_date(F.col("o_orderdate"), dates.offset(F.col("o_custkey"), SALT))).alias("shifted"))


@query(f"SELECT event_id, strftime(ts + to_days({_offset('user_id')}), '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def date_shift_timestamps(spark, d):
    moved = dates.shift_timestamp(F.col("ts"), dates.offset(F.col("user_id"), SALT))
    return t(spark, d, "events").select("event_id", F.date_format(moved, "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("SELECT o_custkey, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE))::BIGINT AS days_before, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE))::BIGINT AS days_after FROM orders GROUP BY o_custkey")
def interval_preserved(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), dates.shift_date(F.col("o_orderdate"), dates.offset(F.col("o_custkey"), SALT)).alias("b"))
    span = lambda c: F.datediff(F.max(c), F.min(c)).cast("bigint")
    return o.groupBy("o_custkey").agg(span("a").alias("days_before"), span("b").alias("days_after"))


@query("""WITH b AS (SELECT c_custkey, DATE '1900-01-01' + (c_custkey * 37 % 36500)::INTEGER AS born FROM customer)
SELECT c_custkey, strftime(CASE WHEN (DATE '2026-01-01' - born) // 365 > 89 THEN DATE '2026-01-01' - 32850 ELSE born END, '%Y-%m-%d') AS born FROM b""")
def age_collapse(spark, d):
    born = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("c_custkey") * 37 % 36500).cast("int"))
    return t(spark, d, "customer").select("c_custkey", day(dates.collapse_age(born, F.lit("2026-01-01").cast("date"))).alias("born"))


# Records


def _customers(spark, d) -> DataFrame:
    c = t(spark, d, "customer")
    return c.select(F.lit("Patient").alias("resource_type"), F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))).alias("data_json"))


def _union(spark, d) -> DataFrame:
    kinds = (("customer", "Patient", "c_custkey"), ("orders", "Encounter", "o_orderkey"), ("lineitem", "Observation", "l_orderkey"), ("documents", "DocumentReference", "doc_id"))
    return schema.merge([t(spark, d, name).select(F.lit(kind).alias("resource_type"), F.col(key).alias("key")) for name, kind, key in kinds], spark)


_UNION = "(SELECT 'Patient' AS resource_type, c_custkey AS key FROM customer UNION ALL SELECT 'Encounter', o_orderkey FROM orders UNION ALL SELECT 'Observation', l_orderkey FROM lineitem UNION ALL SELECT 'DocumentReference', doc_id FROM documents)"


@query(f"SELECT resource_type, count(*) AS n FROM {_UNION} GROUP BY resource_type")
def records_union_counts(spark, d):
    return _union(spark, d).groupBy("resource_type").agg(F.count("*").alias("n"))


@query(f"SELECT resource_type, key FROM {_UNION} WHERE resource_type = 'Encounter'")
def filter_by_type(spark, d):
    return schema.encounters(_union(spark, d))


@query("SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key")
def merge_bag_union(spark, d):
    both = schema.merge([t(spark, d, "customer").select(F.col("c_nationkey").alias("key")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))], spark)
    return both.groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, sha256('Patient' || chr(31) || '{"id":"' || c_custkey || '","name":"' || c_name || '"}' || chr(31) || 'CSV' || chr(31) || 'customer') AS checksum FROM customer""")
def record_checksum(spark, d):
    j = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")))
    return t(spark, d, "customer").select("c_custkey", checksum(F.lit("Patient"), j, F.lit("CSV"), F.lit("customer")).alias("checksum"))


@query("SELECT event_type, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_k, count(*) AS n FROM events GROUP BY event_type")
def json_path_mean(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(private_stats.number(path(F.col("props"), "k"))), 6).alias("mean_k"), F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS key, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_path_histogram(spark, d):
    return private_stats.true_histogram(t(spark, d, "events"), path(F.col("props"), "k"))


@query("SELECT count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS with_field, count(*) AS with_type, count(*) FILTER (WHERE json_extract_string(props, '$.none') IS NOT NULL) AS with_none FROM events")
def count_predicate(spark, d):
    e, kind = t(spark, d, "events"), F.lit("Observation")
    return e.agg(*[F.count_if(private_stats.counts_record(kind, F.col("props"), f)).alias(a) for f, a in (("k", "with_field"), ("Observ", "with_type"), ("none", "with_none"))])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey WHEN c_custkey % 3 = 1 THEN 'S' || c_custkey ELSE 'unknown' END AS patient FROM customer")
def patient_id_of_record(spark, d):
    from ..schema import patient_id

    k = F.col("c_custkey").cast("string")
    j = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"id":"P'), k, F.lit('","subject":{"reference":"Patient/x"}}')))
    j = j.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"id":"","subject":{"reference":"Patient/S'), k, F.lit('"}}'))).otherwise(F.lit('{"subject":{"reference":"none"}}'))
    return t(spark, d, "customer").select("c_custkey", patient_id(j).alias("patient"))


# Differential privacy


@query("SELECT CASE WHEN event_type IS NULL OR event_type = '' THEN 'ungrouped' ELSE event_type END AS key, count(*) AS n FROM events GROUP BY ALL")
def dp_true_count_grouped(spark, d):
    return private_stats.true_count(t(spark, d, "events"), F.lit(True), private_stats.group_key(F.col("event_type")))


@query("SELECT event_type AS key, round(avg(greatest(0, least(100, value))), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def dp_true_mean_clamped(spark, d):
    e = t(spark, d, "events")
    return private_stats.true_mean(e, F.col("value"), 0, 100, F.col("event_type")).select("key", F.round("mean", 6).alias("mean"))


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY ALL")
def dp_true_histogram(spark, d):
    return private_stats.true_histogram(t(spark, d, "orders"), F.col("o_orderpriority"))


@query("SELECT n_nationkey::INTEGER AS seq, n_name AS label, round(0.01 * (1 + n_nationkey % 5), 6)::DOUBLE AS epsilon, round(2 - sum(0.01 * (1 + n_nationkey % 5)) OVER (ORDER BY n_nationkey), 6)::DOUBLE AS epsilon_left FROM nation")
def budget_running(spark, d):
    """A ledger charged once for each nation."""
    budget = private_stats.Budget(2.0)
    for r in t(spark, d, "nation").orderBy("n_nationkey").collect():
        budget.spend(0.01 * (1 + r["n_nationkey"] % 5), label=r["n_name"])
    return budget.to_df(spark).select("seq", "label", F.round("epsilon", 6).alias("epsilon"), F.round("epsilon_left", 6).alias("epsilon_left"))


@query("""WITH a AS (SELECT n_nationkey AS k, 0.05 * (1 + n_nationkey % 5) AS e FROM nation), b AS (SELECT k, e, sum(e) OVER (ORDER BY k) AS upto FROM a)
SELECT k::INTEGER AS seq, 'q' || k AS label, round(2 - upto, 6)::DOUBLE AS epsilon_left FROM b WHERE upto <= 2 + 1e-9""")
def budget_ledger(spark, d):
    """Two drivers take turns at a budget in the shared folder, until it refuses both."""
    path = folder(spark)
    both = [ledger.Ledger(spark, path, 2.0), ledger.Ledger(spark, path)]
    for k, r in enumerate(t(spark, d, "nation").orderBy("n_nationkey").toLocalIterator()):
        try:
            both[k % 2].spend(0.05 * (1 + r["n_nationkey"] % 5), label=f"q{r['n_nationkey']}")
        except BudgetExhaustedError:
            break
    return both[0].to_df(spark).select("seq", "label", F.round("epsilon_left", 6).alias("epsilon_left"))


def _laplace_sql(n: str, scale: str, u: float) -> str:
    """The inverse distribution at a uniform draw from -0.5 to 0.5."""
    return f"({n} - {scale} * ({math.copysign(math.log(1 - 2 * abs(u)), u)!r})::DOUBLE)"


def _draws(seed: int, n: int) -> list[float]:
    rng = random.Random(seed)
    return [rng.random() - 0.5 for _ in range(n)]


_U = _draws(5, 9)


@query(f"""WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)
SELECT 'count:k' AS query, greatest(0, round_even({_laplace_sql("count(k)", "4.0", _U[0])}, 0))::DOUBLE AS answer FROM e
UNION ALL SELECT 'mean:k', round({_laplace_sql("avg(greatest(0, least(50, k)))", "(50.0 / 0.25 / count(k))", _U[1])}, 4) FROM e
UNION ALL SELECT 'histogram:kind', greatest(0, round_even({_laplace_sql("count(*)", "4.0", _U[2])}, 0)) FROM e
UNION ALL SELECT 'count:k|group_by:kind', greatest(0, round_even({_laplace_sql("count(k)", "4.0", _U[3])}, 0)) FROM e""")
def dp_noised(spark, d):
    """Noisy answers by a generator with a fixed seed: counts, a clamped mean and a histogram of one value."""
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("double").alias("k"), F.lit("x").alias("kind")))
    r = t(spark, d, "events").select(F.lit("Observation").alias("resource_type"), j.alias("data_json"))
    asked = [private_stats.Count("k"), private_stats.Mean("k", 0, 50), private_stats.Histogram("kind"), private_stats.Count("k", group_by="kind")]
    got = private_stats.private_stats(r, 1.0, asked, private_stats.Budget(2.0), rng=random.Random(5))
    return spark.createDataFrame([(k, float(v["x"] if isinstance(v, dict) else v)) for k, v in got.values.items()], "query string, answer double")


_SECRET = "a fixed secret, for a test alone"


@query(f"""WITH a AS (SELECT 'count:kind|group_by:user' AS query, user_id::VARCHAR AS key, count(*)::DOUBLE AS n FROM events GROUP BY user_id UNION ALL SELECT 'histogram:kind', event_type, count(*)::DOUBLE FROM events GROUP BY event_type),
t AS (SELECT *, length(query) || ':' || query || '|' || (length(key) + 1) || ':=' || key AS text FROM a),
u AS (SELECT *, (('0x' || left(sha256('{_SECRET}' || sha256('{_SECRET}' || text)), 13))::BIGINT + 0.5) / 4503599627370496.0 - 0.5 AS u FROM t)
SELECT query, key, greatest(round(n - 2.0 * sign(u) * ln(1 - 2 * abs(u))), 0)::DOUBLE AS value FROM u""")
def dp_release(spark, d):
    """Noisy counts of all groups as a table; noise is a keyed function of query and group."""
    j = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user")))
    r = t(spark, d, "events").select(F.lit("Observation").alias("resource_type"), j.alias("data_json"))
    return private_stats.release(r, 1.0, [private_stats.Count("kind", group_by="user"), private_stats.Histogram("kind")], private_stats.Budget(1.0), _SECRET)


_SIGMA = 3.0 * math.sqrt(2 * math.log(1.25 / 1e-5)) / 0.5


@query(f"""SELECT 'laplace' AS mechanism, round({_laplace_sql("count(*)", "4.0", _draws(7, 1)[0])}, 6) AS value FROM customer
UNION ALL SELECT 'gaussian', round(count(*) + ({random.Random(8).gauss(0, _SIGMA)!r})::DOUBLE, 6) FROM customer""")
def mechanisms_release(spark, d):
    """A Laplace and a Gaussian release of one true count by generators with fixed seeds."""
    n = t(spark, d, "customer").count()
    rows = [("laplace", private_stats.Laplace(0.5, 2.0, random.Random(7)).release(n)), ("gaussian", private_stats.Gaussian(0.5, 1e-5, 3.0, random.Random(8)).release(n))]
    return spark.createDataFrame(rows, "mechanism string, value double").select("mechanism", F.round("value", 6).alias("value"))


@query("SELECT round(avg(greatest(10, least(60, value))), 6) AS mean FROM events")
def dp_true_mean(spark, d):
    return private_stats.true_mean(t(spark, d, "events"), F.col("value"), 10, 60).select(F.round("mean", 6).alias("mean"))


# k-anonymity and l-diversity

_RANGE = "(CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal) ELSE floor(c_acctbal) END)"
_LOW = f"(floor({_RANGE} / 1000) * 1000)::BIGINT"
_BAND = f"{_LOW} || '-' || ({_LOW} + 999)"


@query(f"SELECT c_custkey, {_BAND} AS band FROM customer")
def range_generalise(spark, d):
    return t(spark, d, "customer").select("c_custkey", kanonymity.by_range(F.col("c_acctbal"), 1000).alias("band"))


@query("SELECT c_custkey, substr(c_name, 1, 12) AS prefix FROM customer")
def prefix_generalise(spark, d):
    return t(spark, d, "customer").select("c_custkey", kanonymity.by_prefix(F.col("c_name"), 12).alias("prefix"))


@query("SELECT c_custkey, '*' AS c_name FROM customer")
def suppress_generalise(spark, d):
    return kanonymity.generalise(t(spark, d, "customer").select("c_custkey", "c_name"), {"c_name": kanonymity.Rule("suppress")})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS class_size FROM customer GROUP BY ALL")
def kanon_classes(spark, d):
    return kanonymity.classes(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_nationkey, c_mktsegment, count(*) AS class_size FROM customer GROUP BY ALL HAVING count(*) < 12")
def kanon_violations(spark, d):
    return kanonymity.violations(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 12)


@query(f"SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM (SELECT c_custkey, {_BAND} AS c_acctbal, c_mktsegment, c_nationkey, count(*) OVER (PARTITION BY {_BAND}, c_nationkey) AS n FROM customer) WHERE n >= 6")
def kanon_enforce(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return kanonymity.enforce(c, ["c_acctbal", "c_nationkey"], 6, {"c_acctbal": kanonymity.Rule("range", 1000)})


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS n_sensitive FROM part GROUP BY ALL")
def ldiv_classes(spark, d):
    return kanonymity.diversity(t(spark, d, "part"), ["p_brand", "p_size"], "p_type")


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS n_sensitive FROM part GROUP BY ALL HAVING count(DISTINCT p_type) < 2")
def ldiv_violations(spark, d):
    return kanonymity.diversity(t(spark, d, "part"), ["p_brand", "p_size"], "p_type").where(F.col("n_sensitive") < 2)


# Protected health information in text

# The rules that RE2 can say, for SQL.
_RE = {
    "EMAIL": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "PHONE": r"(?i)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "URL": r'(?i)https?://[^\s<>"]+', "ZIP_CODE": r"\b\d{5}(?:-\d{4})?\b", "MRN": r"(?i)\b(?:MR[N]?[-:\s]?\d{4,10})\b",
}


def _found(category: str) -> str:
    return f"regexp_extract_all(text, '{_RE[category]}')"


def _phi_count(category: str, name: str) -> None:
    def run(spark, d):
        return t(spark, d, "documents").select("doc_id", phi.count(F.col("text"), category).cast("bigint").alias("n")).where("n > 0")

    run.__name__ = name
    query(f"SELECT doc_id, len({_found(category)}) AS n FROM documents WHERE len({_found(category)}) > 0")(run)


def _phi_redact(category: str, name: str, table: str, key: str) -> None:
    def run(spark, d):
        new = phi.replace(F.col("text"), category)
        return t(spark, d, table).where(phi.count(F.col("text"), category) > 0).select(key, F.sha2(new, 256).alias("redacted_sha256"), F.length(new).cast("bigint").alias("n_chars"))

    run.__name__ = name
    new = f"regexp_replace(text, '{_RE[category]}', '{phi.BY_CATEGORY[category][0]}', 'g')"
    query(f"SELECT {key}, sha256({new}) AS redacted_sha256, length({new}) AS n_chars FROM {table} WHERE len({_found(category)}) > 0")(run)


for _c, _n in (("EMAIL", "email"), ("PHONE", "phone"), ("IP_ADDRESS", "ip")):
    _phi_count(_c, f"phi_count_{_n}")
    _phi_redact(_c, f"phi_redact_{_n}", "documents", "doc_id")


@query(f"SELECT page_id, len(regexp_extract_all(url, '{_RE['URL']}')) AS n, regexp_replace(url, '{_RE['URL']}', '[URL]', 'g') AS redacted FROM pages")
def phi_url(spark, d):
    return t(spark, d, "pages").select("page_id", phi.count(F.col("url"), "URL").cast("bigint").alias("n"), phi.replace(F.col("url"), "URL").alias("redacted"))


def _literal(name: str, category: str, table: str, key: str, spark_text: Callable[[Column], Column], sql_match: str, miss: str) -> None:
    """A rule over texts made from a table's keys, with `miss`, which it must not take, before them; every third text holds the match twice, every fifth not at all.
    sql_match gives the match in SQL over k."""

    def run(spark, d):
        rows, one = t(spark, d, table).select(F.col(key).alias("k")), spark_text(F.col("k").cast("string"))
        text = F.concat(F.lit(miss + " "), F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 3 == 0, F.concat(one, F.lit(" / "), one)).otherwise(one))
        got = phi.found(text, category)
        return rows.select("k", F.array_join(got, "|").alias("matches"), phi.count(text, category).cast("bigint").alias("n"))

    run.__name__ = name
    n = "CASE WHEN k % 5 = 0 THEN 0 WHEN k % 3 = 0 THEN 2 ELSE 1 END"
    query(f"SELECT k, CASE {n} WHEN 0 THEN '' WHEN 1 THEN {sql_match} ELSE {sql_match} || '|' || {sql_match} END AS matches, ({n})::BIGINT AS n FROM (SELECT {key} AS k FROM {table})")(run)


def _join(*parts) -> Callable[[Column], Column]:
    return lambda k: F.concat(*[p(k) if callable(p) else F.lit(p) for p in parts])


def _pad(n: int) -> Callable[[Column], Column]:
    return lambda k: F.lpad(k, n, "0")


def _sql_pad(n: int) -> str:
    return f"lpad(k::VARCHAR, {n}, '0')"


_SSN = "(substr(p9, 1, 3) || '-' || substr(p9, 4, 2) || '-' || substr(p9, 6, 4))"
_nine = lambda k: F.lpad((k.cast("bigint") * 7919731 % 1000000000).cast("string"), 9, "0")


@query(f"""WITH s AS (SELECT k, lpad((k * 7919731 % 1000000000)::VARCHAR, 9, '0') AS p9 FROM (SELECT c_custkey AS k FROM customer))
SELECT k, CASE WHEN substr(p9, 1, 3) NOT IN ('000', '666') AND substr(p9, 1, 1) <> '9' AND substr(p9, 4, 2) <> '00' AND substr(p9, 6, 4) <> '0000' THEN {_SSN} END AS match FROM s""")
def phi_ssn_valid(spark, d):
    p = _nine(F.col("c_custkey"))
    text = F.concat(F.lit("no "), F.substring(p, 1, 3), F.lit("-"), F.substring(p, 4, 2), F.lit("-"), F.substring(p, 6, 4), F.lit(" ok"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.get(phi.found(text, "SSN"), 0).alias("match"))


_literal("phi_mrn", "MRN", "customer", "c_custkey", _join("see MRN-", _pad(6), " today"), f"'MRN-' || {_sql_pad(6)}", "MRN 123 MRNX-123456")
_literal("phi_account", "ACCOUNT_NUMBER", "customer", "c_custkey", _join("Acct # ", _pad(8), "."), f"'Acct # ' || {_sql_pad(8)}", "Acct # 12345 Accounting 99")
_literal("phi_health_plan", "HEALTH_PLAN", "customer", "c_custkey", _join("his Member ID: H", _pad(7), ", paid"), f"'Member ID: H' || {_sql_pad(7)}", "Member ID: H1 groups")
_literal("phi_license", "LICENSE", "part", "p_partkey", _join("has DEA #A", _pad(8), ";"), f"'DEA #A' || {_sql_pad(8)}", "DEA #A1 deal")
_literal("phi_vehicle", "VEHICLE", "part", "p_partkey", _join("car VIN: 1HGCM826", _pad(9), " sold"), f"'VIN: 1HGCM826' || {_sql_pad(9)}", "1HGCM826OOOOOOOOO VINE 1")
_literal("phi_device", "DEVICE", "part", "p_partkey", _join("a UDI (01)", _pad(10), " in use"), f"'UDI (01)' || {_sql_pad(10)}", "UDI (01)1 Devices")
_literal("phi_zip", "ZIP_CODE", "customer", "c_custkey", _join("Springfield ", _pad(5), "-", _pad(4), "."), f"{_sql_pad(5)} || '-' || {_sql_pad(4)}", "A1234 123456")
_literal("phi_street", "STREET_ADDRESS", "customer", "c_custkey", _join("lives at ", _pad(4), " Old Oak Street now"), f"{_sql_pad(4)} || ' Old Oak Street'", "12Old Oak")


_DATES = " + ".join(rf"len(list_filter(regexp_extract_all(text, '\b{p}\b'), lambda x: try_strptime(x, '{f}') IS NOT NULL))" for f, p in (("%Y-%m-%d", r"\d{4}-\d{2}-\d{2}"), ("%m/%d/%Y", r"\d{2}/\d{2}/\d{4}"), ("%m-%d-%Y", r"\d{2}-\d{2}-\d{4}"), ("%Y%m%d", r"\d{8}")))


@query(f"SELECT doc_id, ({_DATES})::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def phi_dates_in_text(spark, d):
    """Dates that the shifter finds and can read in whole documents."""
    rows = t(spark, d, "documents").where("text is not null").select("doc_id", "text", F.lit(0).alias("days"))
    return dates.shifted(rows, "text", "days", "d", whole_values=False).select("doc_id", F.col("d.n").cast("long").alias("n"))


@query("SELECT c_custkey, 'Jo' || chr((97 + c_custkey % 26)::INTEGER) || ' Smith' AS name FROM customer")
def ner_context_names(spark, d):
    text = F.concat(F.lit("Resident: Jo"), F.chr(F.lit(97) + F.col("c_custkey") % 26), F.lit(" Smith was seen"))
    return t(spark, d, "customer").select("c_custkey", F.get(names.after_cues(text), 0).alias("name"))


@query("SELECT c_custkey, 'Jo' || chr((97 + c_custkey % 26)::INTEGER) AS name FROM customer")
def ner_title_names(spark, d):
    text = F.concat(F.lit("seen by dr. Jo"), F.chr(F.lit(97) + F.col("c_custkey") % 26), F.lit(" on call"))
    return t(spark, d, "customer").select("c_custkey", F.get(names.after_titles(text), 0).alias("name"))


# Engine over whole records


def _notes(spark, d) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    note = F.concat(F.lit("Patient: Jane Roe, mail u"), k, F.lit("@mail.example.com, born 2001-02-03"))
    j = F.to_json(F.struct(F.concat(F.lit("p"), k).alias("id"), note.alias("note"), F.array(F.struct(F.col("c_acctbal").alias("balance"))).alias("more")))
    return t(spark, d, "customer").select(k.alias("id"), F.lit("Patient").alias("resource_type"), j.alias("data_json"), F.lit("CSV").alias("source_format"), F.lit("customer").alias("source_uri"), F.lit("").alias("checksum"))


@query(f"""SELECT 'p' || c_custkey AS pid, 'Patient: [PATIENT_NAME], mail [EMAIL], born ' || strftime(DATE '2001-02-03' + {_offset("('p' || c_custkey)")}, '%Y-%m-%d') AS note FROM customer""")
def engine_clean(spark, d):
    clean, _ = deidentify(_notes(spark, d), Config(date_shift_salt=SALT))
    return clean.select(F.get_json_object("data_json", "$.id").alias("pid"), F.get_json_object("data_json", "$.note").alias("note"))


@query("""SELECT layer, category, action, count(*) AS n FROM customer, (VALUES ('NER', 'PATIENT_NAME', 'PHI_REMOVED'), ('PATTERN', 'EMAIL', 'PHI_REMOVED'), ('DATE_SHIFT', 'DATE', 'DATE_SHIFTED')) v(layer, category, action) GROUP BY ALL""")
def engine_audit(spark, d):
    _, log = deidentify(_notes(spark, d), Config(date_shift_salt=SALT))
    return log.groupBy("layer", "category", "action").agg(F.count("*").alias("n"))


# Audit, compliance, lineage


def _log(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("EMAIL", "PHONE", "DATE", "SSN", "ZIP_CODE"))), (F.col("event_id") % 5 + 1).cast("int"))
    return audit.entries(e.select(
        F.col("user_id").cast("string").alias("record_id"), F.when(F.col("event_id") % 5 == 2, "DATE_SHIFTED").otherwise("PHI_REMOVED").alias("action"), F.when(F.col("event_id") % 5 == 2, "DATE_SHIFT").otherwise("PATTERN").alias("layer"),
        F.col("event_type").alias("original"), F.lit("[X]").alias("replacement"), kind.alias("category"), F.lit(1.0).alias("confidence"), F.col("event_id").alias("seq"),
    ))


_LOG = """(SELECT user_id::VARCHAR AS record_id, event_id AS seq, CASE WHEN event_id % 5 = 2 THEN 'DATE_SHIFTED' ELSE 'PHI_REMOVED' END AS action, CASE WHEN event_id % 5 = 2 THEN 'DATE_SHIFT' ELSE 'PATTERN' END AS layer,
substr(sha256(event_type), 1, 16) AS original_hash, ['EMAIL', 'PHONE', 'DATE', 'SSN', 'ZIP_CODE'][(event_id % 5 + 1)::INTEGER] AS category FROM events)"""


@query(f"""WITH l AS {_LOG} SELECT 'layer' AS kind, layer AS name, count(*) AS n FROM l GROUP BY layer UNION ALL SELECT 'category', category, count(*) FROM l GROUP BY category
UNION ALL SELECT 'action', action, count(*) FROM l GROUP BY action UNION ALL SELECT 'total', 'all', count(*) FROM l UNION ALL SELECT 'phi_removed', 'all', count(*) FROM l WHERE action = 'PHI_REMOVED'""")
def audit_summary(spark, d):
    return audit.summary(_log(spark, d))


@query(f"SELECT count(*) AS phi_removed FROM {_LOG} WHERE action = 'PHI_REMOVED'")
def audit_phi_removed(spark, d):
    return audit.removed_count(_log(spark, d))


@query(f"SELECT seq, original_hash FROM {_LOG} WHERE layer = 'PATTERN' AND category = 'EMAIL'")
def audit_filter(spark, d):
    return audit.filtered(_log(spark, d), layer="PATTERN", category="EMAIL").select(F.col("seq").cast("bigint").alias("seq"), "original_hash")


@query(f"""SELECT seq, CASE WHEN action = 'PHI_REMOVED' THEN '[PHI Removed] ' || category || ' "' || original_hash || '" -> "[X]" (PATTERN, confidence: 1.00)' ELSE '[Date Shifted] [X] (DATE_SHIFT)' END AS line FROM {_LOG}""")
def audit_render(spark, d):
    return audit.render(_log(spark, d)).select(F.col("seq").cast("bigint").alias("seq"), "line")


_DIMENSION = ", ".join(f"({i}, '{n}')" for i, n in enumerate(compliance.IDENTIFIERS, 1))
_MAP = ", ".join(f"('{c}', {i})" for c, i in compliance.CATEGORIES.items())


@query(f"SELECT i.idx, i.name, i.idx IN (SELECT m.idx FROM (VALUES {_MAP}) m(category, idx) WHERE m.category IN (SELECT category FROM {_LOG})) AS addressed FROM (VALUES {_DIMENSION}) i(idx, name)")
def compliance_identifiers(spark, d):
    return compliance.identifiers(_log(spark, d))


def _ops(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_custkey").cast("string").alias("record_id"), F.lit("step").alias("operation"), F.col("o_orderkey").alias("seq"))


@query("SELECT o_orderkey::VARCHAR AS node_id, lag(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_id FROM orders")
def lineage_auto_parent(spark, d):
    return lineage.linked(_ops(spark, d)).select("node_id", F.get("parent_ids", 0).alias("parent_id"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT a.o_orderkey::VARCHAR AS node_id, b.o_orderkey::VARCHAR AS ancestor_id, (a.r - b.r)::INTEGER AS distance FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND b.r <= a.r""")
def lineage_trace(spark, d):
    return lineage.trace_all(lineage.linked(_ops(spark, d)))


@query("SELECT o_custkey::VARCHAR AS record_id, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS node_ids FROM orders GROUP BY o_custkey")
def lineage_index(spark, d):
    return lineage.record_index(_ops(spark, d)).select("record_id", F.array_join("node_ids", ",").alias("node_ids"))


# Synthesis and utility

_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("""SELECT round(avg(l_quantity), 4) AS m1, round(avg(l_extendedprice), 2) AS m2, round(avg(l_discount), 6) AS m3, round(var_samp(l_quantity), 3) AS v1, round(covar_samp(l_quantity, l_discount), 5) AS c13, round(covar_samp(l_quantity, l_extendedprice), 0) AS c12 FROM lineitem""")
def copula_moments(spark, d):
    mean, cov = synthesis.moments(t(spark, d, "lineitem"), _NUM)
    row = (mean[0], mean[1], mean[2], cov[0, 0], cov[0, 2], cov[0, 1])
    df = spark.createDataFrame([tuple(map(float, row))], "a double, b double, c double, d double, e double, f double")
    return df.select(*[F.round(x, n).alias(y) for x, n, y in zip("abcdef", (4, 2, 6, 3, 5, 0), ("m1", "m2", "m3", "v1", "c13", "c12"), strict=True)])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r12, round(corr(l_quantity, l_discount), 6) AS r13, round(corr(l_extendedprice, l_discount), 6) AS r23 FROM lineitem")
def corr_matrix(spark, d):
    r = synthesis.correlations(t(spark, d, "lineitem"), _NUM)
    df = spark.createDataFrame([(float(r[0, 1]), float(r[0, 2]), float(r[1, 2]))], "r12 double, r13 double, r23 double")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("SELECT c_mktsegment AS value, round(count(*) / sum(count(*)) OVER (), 8) AS p FROM customer GROUP BY c_mktsegment")
def marginals(spark, d):
    return synthesis.marginal(t(spark, d, "customer"), "c_mktsegment").select("value", F.round("p", 8).alias("p"))


@query("""WITH a AS (SELECT avg(c_acctbal) m, stddev_samp(c_acctbal) s FROM customer), b AS (SELECT avg(s_acctbal) m, stddev_samp(s_acctbal) s FROM supplier)
SELECT round(((1 - least(abs(a.m - b.m) / greatest(abs(a.m), abs(b.m), 1e-8), 1)) + (1 - least(abs(a.s - b.s) / greatest(abs(a.s), abs(b.s), 1e-8), 1))) / 2, 6) AS score FROM a, b""")
def numeric_fidelity(spark, d):
    stat = lambda df, c: df.agg(F.avg(c), F.stddev_samp(c)).first()
    a, b = stat(t(spark, d, "customer"), "c_acctbal"), stat(t(spark, d, "supplier"), "s_acctbal")
    return spark.createDataFrame([(synthesis.numeric_fidelity(a[0], a[1], b[0], b[1]),)], "score double").select(F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT c_nationkey k, count(*) / sum(count(*)) OVER () p FROM customer GROUP BY 1), b AS (SELECT s_nationkey k, count(*) / sum(count(*)) OVER () q FROM supplier GROUP BY 1)
SELECT round(sum(least(p, q)), 6) AS score FROM a JOIN b USING (k)""")
def categorical_overlap(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return synthesis.overlap(a, b, "k").select(F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT corr(l_quantity, l_discount) r FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT corr(l_quantity, l_discount) r FROM lineitem WHERE l_returnflag <> 'R')
SELECT round(1 - least(sqrt(2 * (a.r - b.r) * (a.r - b.r)) / (sqrt(2 + 2 * a.r * a.r) + 1e-8), 1), 6) AS kept FROM a, b""")
def corr_preservation(spark, d):
    li, cols = t(spark, d, "lineitem"), ["l_quantity", "l_discount"]
    x, y = synthesis.correlations(li.where("l_returnflag = 'R'"), cols), synthesis.correlations(li.where("l_returnflag <> 'R'"), cols)
    kept = 1 - min(np.linalg.norm(x - y) / (np.linalg.norm(x) + 1e-8), 1.0)
    return spark.createDataFrame([(float(kept),)], "kept double").select(F.round("kept", 6).alias("kept"))


_DCR = ["c_acctbal", "c_nationkey"]


@query("""WITH u AS (SELECT c_acctbal a, c_nationkey b FROM customer UNION ALL SELECT s_acctbal, s_nationkey FROM supplier), r AS (SELECT min(a) la, max(a) - min(a) ra, min(b) lb, max(b) - min(b) rb FROM u),
d AS (SELECT s_suppkey, min(sqrt(((s_acctbal - c_acctbal) / ra) ** 2 + ((s_nationkey - c_nationkey) / rb::DOUBLE) ** 2)) AS dcr FROM supplier, customer, r GROUP BY s_suppkey)
SELECT count(*) AS n, round(avg((dcr = 0)::INTEGER), 6) AS exact_match_rate, round(min(dcr), 6) AS min_dcr, round(avg(dcr), 6) AS mean_dcr, round(median(dcr), 6) AS median_dcr, count(*) FILTER (WHERE dcr < 0.05) AS high_risk_count FROM d""")
def dcr_stats(spark, d):
    real = t(spark, d, "customer").select(*_DCR)
    other = t(spark, d, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"))
    out = synthesis.distance_stats(synthesis.closest(*synthesis.scaled(real, other, _DCR)))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("exact_match_rate", "min_dcr", "mean_dcr", "median_dcr")], "high_risk_count")


@query()
def synthetic_sample(spark, d):
    return synthesis.sample(t(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment"), 1000, seed=7)


@query("SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p, true AS near, true AS related")
def copula_quantiles(spark, d):
    """A skewed column keeps its quantiles: the share of real rows below each quantile of 4000 drawn ones is near p. Ranks stay as related as they are."""
    real = t(spark, d, "lineitem").select(F.exp(F.col("l_extendedprice") / 15_000).alias("x"), F.log("l_quantity").alias("y"))
    drawn = settle(synthesis.sample(real, 4000, seed=11))
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    at = drawn.agg(F.percentile("x", F.array(*map(F.lit, ps))).alias("q"), F.corr(F.log("x"), F.exp("y")).alias("r")).first()
    is_ = real.agg(*[F.avg((F.col("x") <= q).cast("int")).alias(f"s{i}") for i, q in enumerate(at["q"])], F.corr(F.log("x"), F.exp("y")).alias("r")).first()
    return spark.createDataFrame([(p, abs(is_[f"s{i}"] - p) < 0.025, abs(is_["r"] - at["r"]) < 0.05) for i, p in enumerate(ps)], "p double, near boolean, related boolean")


@query()
def utility_report(spark, d):
    real = t(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    u = synthesis.evaluate(real, synthesis.sample(real, 1000, seed=7))
    return spark.createDataFrame([(u.fidelity, u.ml_utility, u.reidentification_risk)], "fidelity double, ml_utility double, reidentification_risk double")


# Sources


@query("""SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS pid, c_name AS value FROM customer UNION ALL
SELECT 'Observation', 'Patient/' || c_custkey, printf('%.2f', c_acctbal) FROM customer UNION ALL SELECT 'Condition', 'Patient/' || c_custkey, c_mktsegment FROM customer""")
def csv_map(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("Patient ID"), F.col("c_name").alias("last_name"), F.format_string("%.2f", "c_acctbal").alias("glucose"), F.col("c_mktsegment").alias("Diagnosis"), F.lit("x").alias("other"))
    r, j = tables.table_records(c), lambda p: F.get_json_object("data_json", p)
    return r.select("resource_type", F.coalesce(j("$.id"), j("$.subject.reference")).alias("pid"), F.coalesce(j("$.name[0].family"), j("$.valueString"), j("$.code.display")).alias("value"))


@query("""SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS a, strftime(DATE '1950-01-01' + (c_custkey % 20000)::INTEGER, '%Y-%m-%d') AS b, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS c FROM customer
UNION ALL SELECT 'Observation', '2345-7', c_nationkey::VARCHAR, 'mg/dL' FROM customer UNION ALL SELECT 'Condition', 'E11.9', 'Type 2 Diabetes', 'W' FROM customer""")
def hl7_parse(spark, d):
    k, born = F.col("c_custkey").cast("string"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int")), "yyyyMMdd")
    sex = F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F")
    text = F.concat(F.lit("MSH|^~\\&|A|B|C|D|20240115||ADT^A01\rPID|1||"), k, F.lit("^^^H||Doe^Jo||"), born, F.lit("|"), sex, F.lit("\rOBX|1|NM|2345-7^Glucose^LN||"), F.col("c_nationkey").cast("string"), F.lit("|mg/dL^x\rDG1|1||E11.9^Type 2 Diabetes^I10|||W"))
    r, j = hl7.message_records(t(spark, d, "customer").select(text.alias("m")), "m"), lambda p: F.get_json_object("data_json", p)
    value = F.when(F.col("resource_type") == "Condition", j("$.code.display")).otherwise(F.coalesce(j("$.birthDate"), j("$.valueQuantity.value")))
    return r.select("resource_type", F.coalesce(j("$.id"), j("$.code.code")).alias("a"), value.alias("b"), F.coalesce(j("$.gender"), j("$.valueQuantity.unit"), j("$.category")).alias("c"))


@query("SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS rid FROM customer UNION ALL SELECT 'Observation', 'o' || c_custkey FROM customer")
def fhir_explode(spark, d):
    k = F.col("c_custkey").cast("string")
    bundle = F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"'), k, F.lit('"}},{"resourceType":"Observation","id":"o'), k, F.lit('"},{"resource":{"resourceType":"Unknown"}},{"resource":{"id":"x"}}]}'))
    return fhir.bundle_records(t(spark, d, "customer").select(bundle.alias("b")), "b").select("resource_type", F.get_json_object("data_json", "$.id").alias("rid"))


@query("SELECT resource_type, count(*) AS n FROM (SELECT 'Patient' AS resource_type FROM customer UNION ALL SELECT unnest(['Condition', 'Condition', 'DocumentReference']) FROM customer) GROUP BY resource_type")
def text_records(spark, d):
    text = F.concat(F.lit("Patient: Jo Smith\nDOB: 01/02/1960\nMRN: U"), F.col("c_custkey").cast("string"), F.lit("\nDiagnosis: E11.9 and I10, then E11.9"))
    return docs_source.text_records(t(spark, d, "customer").select(text.alias("x"), F.lit("u").alias("u")), "x", "u").groupBy("resource_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'E11.9,I10,J45.' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS codes FROM customer")
def text_icd_codes(spark, d):
    text = F.concat(F.lit("E11.9, I10, J45."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" and I10"))
    r = docs_source.text_records(t(spark, d, "customer").select(text.alias("x"), F.col("c_custkey").cast("string").alias("u")), "x", "u").where("resource_type = 'Condition'")
    codes = F.array_sort(F.collect_list(F.get_json_object("data_json", "$.code.code")))
    return r.groupBy(F.col("source_uri").cast("bigint").alias("c_custkey")).agg(F.array_join(codes, ",").alias("codes"))


from ..streaming import events as _streaming  # noqa: E402


@query(f"SELECT event_id, strftime(ts + to_days({_offset('user_id')}), '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def streaming_date_shift(spark, d):
    """An extension: the events as a stream, shifted by the same stateless expression."""
    return _streaming.run_once(spark, d, SALT)


from . import flows  # noqa: E402, F401
