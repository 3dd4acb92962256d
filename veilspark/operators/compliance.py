"""Which Safe Harbor identifiers an audit trail covers, and a report of it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import text_file
from .audit import summary_dict

# The identifiers of 45 CFR 164.514(b)(2), the categories that cover them, and those that need a person.
IDENTIFIERS = (
    "Names", "Geographic data (smaller than state)", "Dates (except year) related to an individual", "Phone numbers", "Fax numbers", "Email addresses", "Social Security Numbers", "Medical record numbers",
    "Health plan beneficiary numbers", "Account numbers", "Certificate/license numbers", "Vehicle identifiers and serial numbers", "Device identifiers and serial numbers", "Web URLs", "IP addresses",
    "Biometric identifiers", "Full-face photographs", "Any other unique identifying number or code",
)
CATEGORIES = {
    "PATIENT_NAME": 1, "LOCATION": 2, "DATE": 3, "PHONE": 4, "FAX": 5, "EMAIL": 6, "SSN": 7, "MRN": 8, "HEALTH_PLAN": 9, "ACCOUNT_NUMBER": 10, "LICENSE": 11, "VEHICLE": 12,
    "DEVICE": 13, "URL": 14, "IP_ADDRESS": 15, "BIOMETRIC": 16, "PHOTOGRAPH": 17, "ZIP_CODE": 2, "FACILITY": 2, "ORGANIZATION": 2, "STREET_ADDRESS": 2,
}
BY_HAND = {
    16: "Fingerprints, retinal scans and voiceprints need analysis of sensor data or a manual review.",
    17: "Full-face photographs need image processing or a manual review.",
    18: "Any other identifying code needs verification by a model or a manual review.",
}


def identifiers(audit: DataFrame) -> DataFrame:
    """idx, name, addressed: a row for each of the 18."""
    spark = audit.sparkSession
    names = spark.createDataFrame(list(enumerate(IDENTIFIERS, 1)), "idx int, name string")
    maps = spark.createDataFrame(list(CATEGORIES.items()), "category string, idx int")
    seen = audit.where(F.coalesce("category", F.lit("")) != "").select("category").distinct()
    hit = maps.join(seen, "category", "left_semi").select("idx").distinct().withColumn("addressed", F.lit(True))
    return names.join(hit, "idx", "left").select("idx", "name", F.coalesce("addressed", F.lit(False)).alias("addressed"))


@dataclass(frozen=True)
class Report:
    title: str = "HIPAA Compliance Report"
    generated_at: str = ""
    method: str = "safe_harbor"
    record_count: int = 0
    phi_removed_count: int = 0
    identifiers_addressed: dict = field(default_factory=dict)
    audit_summary: dict = field(default_factory=dict)
    safe_harbor_compliant: bool = False
    notes: list = field(default_factory=list)
    epsilon_used: float | None = None
    epsilon_remaining: float | None = None


def report(audit: DataFrame, record_count: int = 0, method: str = "safe_harbor", epsilon_used: float | None = None, epsilon_remaining: float | None = None) -> Report:
    """Compliant: the method is safe_harbor and no verification found, skipped or failed on anything. Identifiers that don't occur are noted only."""
    found = {r["idx"]: r["addressed"] for r in identifiers(audit).collect()}
    notes, compliant = [], method == "safe_harbor"
    if compliant:
        absent = [f"#{i}: {IDENTIFIERS[i - 1]}" for i in sorted(found) if not found[i] and i not in BY_HAND]
        if absent:
            notes.append(f"Not detected in this data, which may not contain them: {', '.join(absent)}.")
        notes += [f"#{i} ({IDENTIFIERS[i - 1]}): MANUAL REVIEW REQUIRED. {why}" for i, why in BY_HAND.items() if not found[i]]
    steps = dict(audit.where(F.col("layer") == "LLM_VERIFY").groupBy("action").count().collect())
    n = sum(steps.values())
    clean, hits, left, failed = (steps.get(a, 0) for a in ("PHI_VERIFIED_CLEAN", "PHI_DETECTED_LLM", "PHI_VERIFICATION_SKIPPED", "PHI_VERIFICATION_ERROR"))
    if hits:
        notes.append(f"LLM verification detected residual PHI in {hits} of {n} entries.")
    elif left or failed:
        notes.append(f"LLM verification did not complete: {clean} clean, {left} skipped, {failed} failed.")
    elif n:
        notes.append(f"LLM verification completed: {clean} of {n} entries are clean.")
    else:
        notes.append("LLM verification was not enabled; it would give more assurance.")
    total = summary_dict(audit)
    return Report(
        generated_at=datetime.now(UTC).isoformat(), method=method, record_count=record_count, phi_removed_count=total["phi_removed"], identifiers_addressed={IDENTIFIERS[i - 1]: found[i] for i in sorted(found)},
        audit_summary=total, safe_harbor_compliant=compliant and not (hits or left or failed), notes=notes, epsilon_used=epsilon_used, epsilon_remaining=epsilon_remaining,
    )


def save_json(r: Report, path: str) -> None:
    with text_file(path) as write:
        write(json.dumps(asdict(r), indent=2, ensure_ascii=False))


def to_markdown(r: Report) -> str:
    facts = {"Generated": r.generated_at, "Method": r.method, "Records processed": r.record_count, "PHI items removed": r.phi_removed_count, "Safe Harbor compliant": "Yes" if r.safe_harbor_compliant else "No"}
    parts = [f"# {r.title}\n", "\n".join(f"**{k}:** {v}  " for k, v in facts.items()) + "\n"]
    if r.epsilon_used is not None:
        parts.append(f"## Differential Privacy\n\n- Epsilon spent: {r.epsilon_used:.4f}\n- Epsilon remaining: {r.epsilon_remaining or 0:.4f}\n")
    table = "\n".join(f"| {i} | {name} | {'Yes' if ok else 'N/A'} |" for i, (name, ok) in enumerate(r.identifiers_addressed.items(), 1))
    parts.append(f"## Safe Harbor Identifiers\n\n| # | Identifier | Addressed |\n|---|---|---|\n{table}\n")
    parts.append("## Audit Summary\n\n" + "\n".join(f"- **{k}:** {v}" for k, v in r.audit_summary.items()) + "\n")
    if r.notes:
        parts.append("## Notes\n\n" + "\n".join(f"- {n}" for n in r.notes) + "\n")
    return "\n".join(parts)
