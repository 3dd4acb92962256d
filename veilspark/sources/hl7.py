"""HL7v2 messages, parsed by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import empty, records
from . import framed


def messages(text: Column) -> Column:
    """Messages of a text: each starts with a line MSH|."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^MSH\|)"), F.trim), lambda m: m != "")


def segments(message: Column) -> Column:
    """Array of fields for each line that isn't blank."""
    lines = F.filter(F.transform(F.split(message, r"\r\n|\r|\n"), F.trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.split(x, r"\|"))


def named(parsed: Column, segment: str) -> Column:
    return F.filter(parsed, lambda f: f[0] == segment)


def part(fields: Column, field: int, component: int | None = None) -> Column:
    """A field, counted from 1 (in MSH the separator is the first), or its component from 0; "" if there is none."""
    at = F.when(fields[0] == "MSH", F.lit(field - 1)).otherwise(F.lit(field))
    value = F.coalesce(F.get(fields, at), F.lit(""))
    return value if component is None else F.coalesce(F.get(F.split(value, r"\^"), F.lit(component)), F.lit(""))


def timestamp(raw: Column) -> Column:
    """yyyyMMdd with hours, minutes and seconds as far as they are given; null otherwise."""
    digits = F.regexp_extract(F.trim(raw), r"^(\d{8}(?:\d{2}){0,3})", 1)
    return F.when(digits != "", F.try_to_timestamp(F.rpad(digits, 14, "0"), F.lit("yyyyMMddHHmmss")))


def _patient(p: Column, null_dates: bool) -> Column:
    sex, phone, ssn = part(p, 8), part(p, 13), part(p, 19)
    born = F.lit(None).cast("string") if null_dates else F.date_format(timestamp(part(p, 7)), "yyyy-MM-dd")
    has = lambda c: F.filter(F.array(c), lambda x: x != "")
    pair = lambda system, v: F.filter(F.array(F.struct(F.lit(system).alias("system"), v.alias("value"))), lambda x: x["value"] != "")
    ident = part(p, 3, 0)
    return F.to_json(F.struct(
        F.lit("Patient").alias("resourceType"), F.when(ident != "", ident).alias("id"), F.array(F.struct(part(p, 5, 0).alias("family"), has(part(p, 5, 1)).alias("given"))).alias("name"), born.alias("birthDate"),
        F.when(sex == "M", "male").when(sex == "F", "female").when(sex == "O", "other").otherwise("unknown").alias("gender"),
        F.array(F.struct(has(part(p, 11, 0)).alias("line"), part(p, 11, 2).alias("city"), part(p, 11, 3).alias("state"), part(p, 11, 4).alias("postalCode"))).alias("address"),
        pair("phone", phone).alias("telecom"), pair("SSN", ssn).alias("identifier"),
    ))


def _observation(o: Column, null_dates: bool) -> Column:
    system, at = part(o, 3, 2), timestamp(part(o, 14))
    when = F.lit(None).cast("string") if null_dates else F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.to_json(F.struct(
        F.lit("Observation").alias("resourceType"), F.struct(F.when(system == "", "LOINC").otherwise(system).alias("system"), part(o, 3, 0).alias("code"), part(o, 3, 1).alias("display")).alias("code"),
        F.struct(part(o, 5).alias("value"), part(o, 6, 0).alias("unit")).alias("valueQuantity"), when.alias("effectiveDateTime"),
    ))


def _condition(d: Column) -> Column:
    text = part(d, 4)
    return F.to_json(F.struct(
        F.lit("Condition").alias("resourceType"), F.struct(F.lit("ICD-10-CM").alias("system"), part(d, 3, 0).alias("code"), F.when(text != "", text).otherwise(part(d, 3, 1)).alias("display")).alias("code"), part(d, 6).alias("category"),
    ))


def message_records(df: DataFrame, text_col: str, uri_col: str | None = None, compat_null_dates: bool = False) -> DataFrame:
    """A patient for each message with PID, then an observation for each OBX and a condition for each DG1. compat_null_dates: leave all dates null."""
    split = df.select((F.col(uri_col) if uri_col else F.lit("")).alias("uri"), F.posexplode(messages(F.col(text_col))).alias("n", "m"))
    return _records(split, compat_null_dates)


def _records(split: DataFrame, compat_null_dates: bool) -> DataFrame:
    """uri, n and text m of messages -> records."""
    parsed = split.select("uri", "n", segments(F.col("m")).alias("s"))
    s = F.col("s")
    row = lambda t, f: lambda x: F.struct(F.lit(t).alias("t"), f(x).alias("j"))
    every = F.concat(
        F.transform(F.slice(named(s, "PID"), 1, 1), row("Patient", lambda x: _patient(x, compat_null_dates))),
        F.transform(named(s, "OBX"), row("Observation", lambda x: _observation(x, compat_null_dates))),
        F.transform(named(s, "DG1"), row("Condition", _condition)),
    )
    rows = parsed.select("uri", "n", F.posexplode(every).alias("k", "r"))
    return records(rows, F.col("r.t"), F.col("r.j"), "HL7v2", F.col("uri"), F.concat_ws("-", "n", "k"))


def read_hl7(spark: SparkSession, path: str, compat_null_dates: bool = False) -> DataFrame:
    """Files by path or pattern, each read by as many tasks as it has byte ranges (see framed); no match gives no records."""
    try:
        found = framed.messages(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark)
        raise
    return _records(found.select("uri", "n", F.trim("text").alias("m")), compat_null_dates)
