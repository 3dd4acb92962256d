"""The audit trail as a DataFrame: hashed originals, summaries, rendering, sinks."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import iso, json_file
from ..sources import framed

ENTRIES = "record_id string, seq int, action string, layer string, original_hash string, replacement string, category string, confidence double, at timestamp"


def digest(original: Column, key: str = "") -> Column:
    """First 16 hex digits of SHA-256, "" for "". A key keeps short originals from being found by trying all of them."""
    original = F.coalesce(original, F.lit(""))
    return F.when(original == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(key), original), 256), 1, 16))


def entries(df: DataFrame, key: str = "") -> DataFrame:
    """Rows with `original` to entries with its hash; a column original_hash counts where it is there already."""
    have = F.col("original_hash") if "original_hash" in df.columns else F.lit("")
    hashed = F.when(F.coalesce(have, F.lit("")) != "", have).otherwise(digest(F.col("original"), key)) if "original" in df.columns else have
    at = F.col("at") if "at" in df.columns else F.current_timestamp()
    seq = F.col("seq").cast("int") if "seq" in df.columns else F.lit(0)
    return df.select("record_id", seq.alias("seq"), "action", "layer", hashed.alias("original_hash"), "replacement", "category", F.col("confidence").cast("double").alias("confidence"), at.alias("at"))


def filtered(audit: DataFrame, *, layer: str | None = None, action: str | None = None, category: str | None = None) -> DataFrame:
    for name, value in (("layer", layer), ("action", action), ("category", category)):
        audit = audit if value is None else audit.where(F.col(name) == value)
    return audit


def removed_count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if(F.col("action") == "PHI_REMOVED").alias("phi_removed"))


def summary(audit: DataFrame) -> DataFrame:
    """kind (total, phi_removed, layer, category, action), name, n: one pass by grouping sets."""
    view = audit.select("layer", "category", "action")
    sets = view.groupingSets([[F.col("layer")], [F.col("category")], [F.col("action")], []], "layer", "category", "action").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.col("action") == "PHI_REMOVED").alias("gone")
    )
    kind = F.when(F.col("g") == 3, "layer").when(F.col("g") == 5, "category").when(F.col("g") == 6, "action").otherwise("total")
    name = F.coalesce("layer", "category", "action")
    one = F.array(F.struct(kind.alias("kind"), F.when(F.col("g") < 7, F.coalesce(name, F.lit(""))).otherwise("all").alias("name"), F.col("n").alias("n")))
    also = F.when(F.col("g") == 7, F.array(F.struct(F.lit("phi_removed").alias("kind"), F.lit("all").alias("name"), F.col("gone").alias("n")))).otherwise(F.array().cast("array<struct<kind:string,name:string,n:bigint>>"))
    return sets.select(F.inline(F.concat(one, also)))


def summary_dict(audit: DataFrame) -> dict:
    """The summary on the driver: its size is the number of layers, categories and actions."""
    out: dict = {"total_entries": 0, "phi_removed": 0, "by_layer": {}, "by_category": {}, "by_action": {}}
    for kind, name, n in summary(audit).collect():
        if kind == "total":
            out["total_entries"] = n
        elif kind == "phi_removed":
            out["phi_removed"] = n
        else:
            out[f"by_{kind}"][name] = n
    return out


# How an entry of each action reads, and any other; names in braces are the entry's columns.
LINES = {
    "PHI_REMOVED": '[PHI Removed] {category} "{original_hash}" -> "{replacement}" ({layer}, confidence: {confidence})',
    "DATE_SHIFTED": "[Date Shifted] {replacement} ({layer})",
    "PHI_VERIFIED_CLEAN": "[PHI Verified] LLM found no additional PII in free-text fields",
    "PHI_DETECTED_LLM": "[PHI Detected] LLM found: {original_hash} ({category}, confidence: {confidence})",
    "PHI_VERIFICATION_SKIPPED": "[PHI Verification Skipped] LLM verification was not run ({replacement})",
    "PHI_VERIFICATION_ERROR": "[PHI Verification Error] LLM verification failed ({replacement})",
}
OTHER = "[{action}] {category}: {replacement} ({layer})"


def render(audit: DataFrame) -> DataFrame:
    """record_id, seq, line: how an entry reads."""

    def filled(line: str) -> Column:
        parts = [(F.lit(text), name) for text, name, _, _ in Formatter().parse(line)]
        value = lambda name: F.format_string("%.2f", F.col(name)) if name == "confidence" else F.col(name)
        return F.concat(*[c for text, name in parts for c in ([text, value(name)] if name else [text])])

    known = F.coalesce(*[F.when(F.col("action") == action, filled(line)) for action, line in LINES.items()])
    return audit.select("record_id", "seq", F.when(F.col("action").isin(*LINES), known).otherwise(filled(OTHER)).alias("line"))


def append(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(path)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an exported log: a JSON object whose `entries` are objects. Missing fields are "" (confidence 1); an `original` that is still there is hashed; `at` may be called timestamp.
    The file is read by byte ranges, whatever its size (see framed)."""
    fields = "record_id string, seq int, action string, layer string, original string, original_hash string, replacement string, category string, confidence double, at string, timestamp string"
    e = framed.objects(spark, path, "entries", fields)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("record_id", "action", "layer", "original", "original_hash", "replacement", "category")]
    at = F.coalesce(F.col("at"), F.col("timestamp")).try_cast("timestamp").alias("at")
    return entries(e.select(*blank, F.coalesce("seq", "n").alias("seq"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), at))


def save_json(audit: DataFrame, path: str, run_id: str | None = None) -> None:
    """Export of a log of any size, as to_json gives it, an entry a line. Entries are written by tasks; the summary is another pass over the log."""
    columns = [iso(F.col(c)).alias(c) if c == "at" else F.col(c) for c in audit.columns]
    json_file(audit, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), path, json.dumps(_about(audit, run_id), indent=2, ensure_ascii=False)[:-2] + ',\n  "entries": [\n', "]\n}\n")


def to_json(audit: DataFrame, run_id: str | None = None) -> str:
    """Export of a log that fits the driver as text, with run id and summary; save_json() and append() are for logs of any size."""
    rows = [r.asDict() | {"at": r["at"].isoformat() if r["at"] else None} for r in audit.toLocalIterator()]
    return json.dumps(_about(audit, run_id) | {"entries": rows}, indent=2, ensure_ascii=False)


def _about(audit: DataFrame, run_id: str | None) -> dict:
    return {"pipeline_run_id": run_id or str(uuid.uuid4()), "exported_at": datetime.now(UTC).isoformat(), "summary": summary_dict(audit)}
