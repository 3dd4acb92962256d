"""The record model: one DataFrame of records, whatever the source.

`data_json` keeps the source's key order and number spelling; paths are read from it where they are asked for. Columns that queries need often belong
beside it as plain columns, so that filters and pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.shared import iso, json_file
from .sources import framed

# FHIR R4 resource types that the model knows.
RESOURCE_TYPES = ("Patient", "Observation", "Condition", "MedicationRequest", "Encounter", "DiagnosticReport", "Procedure", "AllergyIntolerance", "Immunization", "DocumentReference")

RECORDS = "id string, resource_type string, data_json string, source_format string, source_uri string, ingested_at timestamp, checksum string"
COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


def checksum(resource_type: Column, data_json: Column, source_format: Column, source_uri: Column) -> Column:
    """SHA-256 of what a record says; id and time of ingestion don't count."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in (resource_type, data_json, source_format, source_uri)]), 256)


def records(df: DataFrame, resource_type: Column, data_json: Column, source_format: str, source_uri: Column, ordinal: Column | None = None) -> DataFrame:
    """Records from the rows of df. Ids are hashes of content and ordinal, so that recomputed partitions give the same ids."""
    base = df.select(
        resource_type.alias("resource_type"), data_json.alias("data_json"), F.lit(source_format).alias("source_format"), source_uri.alias("source_uri"), F.current_timestamp().alias("ingested_at"),
        (F.lit(0) if ordinal is None else ordinal).cast("string").alias("__n"),
    )
    base = base.where(F.col("resource_type").isin(*RESOURCE_TYPES))
    total = checksum(F.col("resource_type"), F.col("data_json"), F.col("source_format"), F.col("source_uri"))
    return base.withColumn("checksum", total).withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "checksum", "__n"), 256), 1, 32)).select(*COLUMNS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORDS)


def merge(parts: Sequence[DataFrame], spark: SparkSession) -> DataFrame:
    """Bag union in the order given."""
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def of_type(df: DataFrame, resource_type: str) -> DataFrame:
    return df.where(F.col("resource_type") == resource_type)


def patients(df: DataFrame) -> DataFrame:
    return of_type(df, "Patient")


def observations(df: DataFrame) -> DataFrame:
    return of_type(df, "Observation")


def conditions(df: DataFrame) -> DataFrame:
    return of_type(df, "Condition")


def encounters(df: DataFrame) -> DataFrame:
    return of_type(df, "Encounter")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON file {"records": [...]} with each record's data as an object. Records are written by tasks (see json_file)."""
    own = [iso(F.col(c)).alias(c) if c == "ingested_at" else F.col(c) for c in COLUMNS if c != "data_json"]
    row = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    data = F.coalesce(F.nullif(F.col("data_json"), F.lit("")), F.lit("null"))
    json_file(df, F.concat(F.substr(row, F.lit(1), F.length(row) - 1), F.lit(',"data":'), data, F.lit("}")), path, '{"records": [\n', "]}\n")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of such files; a record without a checksum gets that of its content, one without an id that checksum's beginning. Files are read by byte ranges, whatever their size (see framed)."""
    kind = "id string, resource_type string, data string, source_format string, source_uri string, ingested_at string, checksum string"
    rows = framed.objects(spark, path, "records", kind).drop("n")
    total = checksum(F.col("resource_type"), F.col("data"), F.col("source_format"), F.col("source_uri"))
    rows = rows.withColumn("checksum", F.coalesce(F.when(F.col("checksum") != "", F.col("checksum")), total))
    return rows.select(F.coalesce("id", F.substring("checksum", 1, 32)).alias("id"), "resource_type", F.col("data").alias("data_json"), "source_format", "source_uri", F.col("ingested_at").try_cast("timestamp").alias("ingested_at"), "checksum")


def to_dicts(df: DataFrame):
    """An iterator over the records' data; rows come to the driver a partition at a time."""
    import json

    return (json.loads(r.data_json) for r in df.select("data_json").toLocalIterator())


def path(data_json: Column, dotted: str) -> Column:
    """The value at a dotted path of objects as text; null beyond a list, a missing key or an empty path."""
    return F.get_json_object(data_json, "$." + dotted) if dotted else F.lit(None).cast("string")


def present(value: Column) -> Column:
    """Null, "", [] and {} are absent; 0 and false are present."""
    return value.isNotNull() & ~value.isin("", "[]", "{}")


def patient_id(data_json: Column, prefer_subject: bool = False) -> Column:
    """The record's own id, else the last part of subject.reference, else "unknown". prefer_subject: the subject first, so that all of a patient's records share one offset."""
    own = F.get_json_object(data_json, "$.id")
    own = F.when(own.isin("", "0", "false", "[]", "{}"), None).otherwise(own)
    ref = F.get_json_object(data_json, "$.subject.reference")
    subject = F.when(F.contains(ref, F.lit("/")), F.element_at(F.split(ref, "/"), -1))
    return F.coalesce(*((subject, own) if prefer_subject else (own, subject)), F.lit("unknown"))
