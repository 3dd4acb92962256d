"""De-identification of records: names, patterns, dates, and verification by a model, in this order, with an audit trail from the same pass."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import dates, names, phi, rewrite
from ..functions.names import Names
from ..functions.phi import Matcher, any_phi
from ..functions.shared import dealt, settle
from ..functions.trees import map_strings, strings
from ..schema import checksum, patient_id
from . import audit

_ENTRY = StructType([StructField(n, DoubleType() if n == "confidence" else StringType()) for n in ("action", "layer", "original", "replacement", "category", "confidence")])
_RESULT = StructType([StructField("data_json", StringType()), StructField("entries", ArrayType(_ENTRY))])

#: A verifier takes a record's strings as one text and returns (status, findings): "clean", "findings", "skipped" or "error", and dicts with text, category, confidence.
Verifier = Callable[[str], tuple[str, list[dict]]]


@dataclass(frozen=True)
class Config:
    """compat switches give what the rules literally say where the default mends it: spliced overlaps, dates before a time left, the record's own id before the subject."""

    date_shift: bool = True
    date_shift_range: tuple[int, int] = dates.RANGE
    date_shift_salt: str = ""
    extra_patterns: tuple[tuple[str, str], ...] = ()
    llm_verification: bool = False
    verifier: Verifier | None = None
    compat_splice: bool = False
    compat_dates: bool = False
    prefer_subject: bool = True
    show_offset: bool = False
    audit_key: str = ""


def ensure_salt(config: Config) -> Config:
    """A salt of its own for a run that shifts dates without one."""
    return replace(config, date_shift_salt=secrets.token_urlsafe(32)) if config.date_shift and not config.date_shift_salt.strip() else config


def skipped(text: str) -> tuple[str, list[dict]]:
    return "skipped", []


def _processor(config: Config):
    def entry(action, layer, original, replacement, category, confidence=1.0) -> dict:
        return {"action": action, "layer": layer, "original": original, "replacement": replacement, "category": category, "confidence": confidence}

    def one(data: str | None, patient: str, days: int | None, names: Names, rules: Matcher, shifter: dates.Shifter) -> dict:
        if data is None:
            return {"data_json": None, "entries": []}
        value, log = json.loads(data), []
        before = value

        def by_name(text: str) -> str:
            text, got = names.redact(text)
            log.extend(entry("PHI_REMOVED", "NER", e.text, f"[{e.category}]", e.category, e.confidence) for e in got)
            return text

        def by_rule(text: str) -> str:
            text, got = rules.redact(text, config.compat_splice)
            log.extend(entry("PHI_REMOVED", "PATTERN", m.original, m.replacement, m.category, m.confidence) for m in got)
            return text

        value = map_strings(map_strings(value, by_name), by_rule)
        if config.date_shift:
            moved = 0

            def by_date(text: str) -> str:
                nonlocal moved
                text, n = shifter.value(text, days)
                moved += n
                return text

            value = map_strings(value, by_date)
            says = (f"offset={days} days; " if config.show_offset else "") + f"shifted_dates={moved}"
            log.append(entry("DATE_SHIFTED", "DATE_SHIFT", f"patient={patient}", says, "DATE"))
        if config.llm_verification:
            status, found = (config.verifier or skipped)("\n---\n".join(strings(value)))
            if found:
                log.extend(entry("PHI_DETECTED_LLM", "LLM_VERIFY", f.get("text", ""), f"[{f.get('category', 'UNKNOWN')}]", f.get("category", "UNKNOWN"), float(f.get("confidence", 0.5))) for f in found)
            else:
                action, sure = {"clean": ("PHI_VERIFIED_CLEAN", 1.0), "skipped": ("PHI_VERIFICATION_SKIPPED", 0.0)}.get(status, ("PHI_VERIFICATION_ERROR", 0.0))
                log.append(entry(action, "LLM_VERIFY", "", {"clean": "", "skipped": "no verifier"}.get(status, "verification failed"), "NONE", sure))
        return {"data_json": data if value == before else json.dumps(value, ensure_ascii=False, separators=(",", ":")), "entries": log}

    @pandas_udf(_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tools = Names(), Matcher(dict(config.extra_patterns)), dates.Shifter(timed=not config.compat_dates)
        for data, patient, days in batches:
            yield pd.DataFrame([one(d, p, None if o is None or o != o else int(o), *tools) for d, p, o in zip(data, patient, days, strict=True)], columns=["data_json", "entries"])

    return run


def _native(df: DataFrame, config: Config) -> DataFrame:
    """df (__text, a record's JSON or null, __who and __days) with __json and __entries by expressions alone. Of the text only strings with a match change.

    The layers are projections over arrays of the record's strings, one after another; strings that a cheap test clears are null in them.
    """
    array = _RESULT["entries"].dataType
    c = F.col
    df = df.withColumn("__s", rewrite.json_strings(c("__text")))
    df = df.withColumn("__0", F.transform("__s", lambda s: F.when(any_phi(s["value"]), s["value"])))
    df = df.withColumn("__names", F.transform("__0", names.spans))
    df = df.withColumn("__1", F.zip_with("__0", "__names", names.redacted))
    df = df.withColumn("__rules", F.transform("__1", phi.spans))
    df = df.withColumn("__2", F.zip_with("__1", "__rules", phi.redacted))
    of = lambda values: F.array(*map(F.lit, values))

    def entries(spans: str, layer: str, replacement, category, confidence) -> Column:
        def entry(x: Column) -> Column:
            return F.struct(F.lit("PHI_REMOVED").alias("action"), F.lit(layer).alias("layer"), x["original"].alias("original"), replacement(x).alias("replacement"), category(x).alias("category"), confidence(x).alias("confidence"))

        return F.transform(F.flatten(F.filter(spans, lambda s: s.isNotNull())), entry).cast(array)

    logs = [
        entries("__names", "NER", lambda x: F.lit("[PATIENT_NAME]"), lambda x: F.lit("PATIENT_NAME"), lambda x: F.get(of((names.TITLE_CONFIDENCE, names.CUE_CONFIDENCE)), x["rule"])),
        entries("__rules", "PATTERN", lambda x: F.get(of([to for _, to, _ in phi.RULES]), x["rule"]), lambda x: F.get(of([k for k, _, _ in phi.RULES]), x["rule"]), lambda x: F.lit(1.0)),
    ]
    if config.date_shift:
        df = dates.shifted(df, "__2", "__days", "__d", timed=not config.compat_dates)
        moved = F.aggregate("__d", F.lit(0), lambda n, d: n + F.coalesce(d["n"], F.lit(0)))
        logs.append(F.array(_date_entry(config, c("__who"), c("__days"), moved)).cast(array))
        df = df.withColumn("__2", F.transform("__d", lambda d: d["text"]))
    new = F.zip_with("__s", "__2", lambda s, t: F.when(t != s["value"], t))
    df = df.withColumn("__json", rewrite.joined_json(c("__text"), c("__s"), new)).withColumn("__entries", F.when(c("__text").isNull(), F.array().cast(array)).otherwise(F.concat(*logs)))
    return df.drop("__s", "__0", "__names", "__1", "__rules", "__2", "__d")


def _date_entry(config: Config, who: Column, days: Column, moved: Column) -> Column:
    said = F.concat(F.concat(F.lit("offset="), days, F.lit(" days; ")) if config.show_offset else F.lit(""), F.lit("shifted_dates="), moved)
    return F.struct(F.lit("DATE_SHIFTED").alias("action"), F.lit("DATE_SHIFT").alias("layer"), F.concat(F.lit("patient="), who).alias("original"), said.alias("replacement"), F.lit("DATE").alias("category"), F.lit(1.0).alias("confidence"))


def deidentify(records: DataFrame, config: Config, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clean records, audit entries). Both derive from one deterministic expression, so recomputing either cannot part them.

    once: write both, with hashed originals, to the shared folder and read them from there, so that records pass the layers a single time where both are used.
    Everything is an expression (see _native) but where a plug-in has a say: extra patterns, which are Python's, a verifier, or compat_splice; those records go through Python in Arrow batches.
    Records that a cheap native test finds free of digits, cues and rules' words do not pass them at all; they keep their text. The clean record's checksum is that of its new content.
    The layers cost far more than reading does, so a source of a few bytes is dealt out to all cores before them (see dealt).
    """
    if config.date_shift:
        dates.check(config.date_shift_salt, config.date_shift_range)
    who = patient_id(F.col("data_json"), config.prefer_subject)
    days = dates.offset(F.col("__who"), config.date_shift_salt, config.date_shift_range) if config.date_shift else F.lit(None).cast("int")
    needs = F.lit(True) if config.llm_verification or config.extra_patterns else any_phi(F.col("data_json")) | F.contains("data_json", F.lit("\\"))
    done = dealt(records).withColumn("__who", who).withColumn("__days", days).withColumn("__needs", F.coalesce(needs, F.lit(False)))
    plug_in = config.llm_verification or config.extra_patterns or config.compat_splice
    done = done.withColumn("__text", F.when(F.col("__needs"), F.col("data_json")))
    if plug_in:
        done = done.withColumn("__r", _processor(config)("__text", "__who", "__days")).withColumn("__json", F.col("__r.data_json")).withColumn("__entries", F.col("__r.entries")).drop("__r")
    else:
        done = _native(done, config)
    # Text and entries are columns apart, so that who reads one of them does not pay for the other.
    none = F.array().cast(_RESULT["entries"].dataType)
    plain = F.array(_date_entry(config, F.col("__who"), F.col("__days"), F.lit(0))).cast(_RESULT["entries"].dataType) if config.date_shift else none
    done = done.withColumn("__json", F.when(F.col("__needs"), F.col("__json")).otherwise(F.col("data_json")))
    done = done.withColumn("__entries", F.when(F.col("__needs"), F.col("__entries")).when(F.col("data_json").isNull(), none).otherwise(plain)).drop("__text")
    if once:
        e = F.transform("__entries", lambda x: x.withField("original", audit.digest(x["original"], config.audit_key)))
        done = settle(done.withColumn("__entries", e).drop("__days", "__needs", "data_json"))
    clean = done.withColumn("data_json", F.col("__json")).select(*records.columns)
    clean = clean.withColumn("checksum", checksum(F.col("resource_type"), F.col("data_json"), F.col("source_format"), F.col("source_uri")))
    # Outer: else the optimizer infers a filter on the entries' number and pushes it below the layers, where it holds all of them in one expression, with each use of a layer worked out anew.
    rows = done.select(F.col("id").alias("record_id"), F.posexplode_outer("__entries").alias("seq", "e")).where("seq is not null").select("record_id", "seq", "e.*")
    return clean, audit.entries(rows.withColumnRenamed("original", "original_hash") if once else rows, config.audit_key)
