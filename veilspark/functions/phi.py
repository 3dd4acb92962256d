"""Pattern rules for protected health information: native scans and counts, and redaction with spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rewrite

# Category, placeholder and pattern in order of precedence; all ignore case. The patterns are the same in Python and Java.
# Rule 13 is written without a repeated group, whose recursion ends the JVM on long texts; it matches the same spans.
RULES = (
    ("SSN", "[SSN]", r"(?:\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b|(?:SSN|Social\s+Security|SS#)\s*:?\s*(?!000|666|9\d{2})\d{3}-?(?!00)\d{2}-?(?!0000)\d{4})"),
    ("PHONE", "[PHONE]", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL", "[EMAIL]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("MRN", "[MRN]", r"\b(?:MR[N]?[-:\s]?\d{4,10})\b"),
    ("ACCOUNT_NUMBER", "[ACCOUNT]", r"\b(?:Account|Acct|Policy|Insurance)\s*#?\s*:?\s*\d{6,}\b"),
    ("HEALTH_PLAN", "[HEALTH_PLAN]", r"\b(?:(?:Health\s*Plan|Beneficiary|Member(?:\s*ID)?|Group|Subscriber)\s*#?\s*:?\s*[A-Z0-9]{4,20})\b"),
    ("LICENSE", "[LICENSE]", r"\b(?:(?:License|Licence|Certificate|Cert|DEA|NPI|UPIN)\s*#?\s*:?\s*[A-Z0-9]{4,15})\b"),
    ("VEHICLE", "[VEHICLE]", r"\b(?:(?:VIN|Vehicle)\s*#?\s*:?\s*[A-HJ-NPR-Z0-9]{17}|[A-HJ-NPR-Z0-9]{17}(?=\s|$|[.,;]))\b"),
    ("DEVICE", "[DEVICE]", r"\b(?:(?:UDI|Device|Serial)\s*#?\s*:?\s*[A-Z0-9()/-]{6,30})\b"),
    ("IP_ADDRESS", "[IP]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("URL", "[URL]", r"https?://[^\s<>\"]+"),
    ("ZIP_CODE", "[ZIP]", r"\b\d{5}(?:-\d{4})?\b"),
    ("STREET_ADDRESS", "[ADDRESS]", r"\b\d+\s+\w[\w\s]*\s(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl|Street|Avenue|Boulevard|Drive|Road|Lane|Court|Place)\b"),
)
BY_CATEGORY = {c: (placeholder, pattern) for c, placeholder, pattern in RULES}


def java(category: str) -> str:
    """The rule for Spark's expressions."""
    return "(?i)" + rewrite.as_java(BY_CATEGORY[category][1])


def count(text: Column, category: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(java(category))), F.lit(0))


def found(text: Column, category: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java(category)), F.lit(0))


def replace(text: Column, category: str) -> Column:
    """One rule alone, in the JVM."""
    return F.regexp_replace(text, java(category), BY_CATEGORY[category][0].replace("$", r"\$"))


def any_phi(text: Column) -> Column:
    """A cheap test that all texts with a match of a rule, a name or a date pass: they need no Python if they don't."""
    return F.rlike(text, F.lit(r"(?iU)[\d@]|https?://|group|member|beneficiary|subscriber|health\s*plan|licen[sc]e|cert|dea|npi|upin|vin|vehicle|udi|device|serial|[A-HJ-NPR-Z0-9]{17}|\b(?:mr|mrs|ms|miss|dr|prof|pt)\b|patient|name|pt|resident|client"))


def spans(text: Column) -> Column:
    """Every match of every rule, overlapping ones too, by start and then by rule; see rewrite.SPANS. Null for null."""
    return F.when(text.isNotNull(), F.array_sort(F.transform(F.concat(*[rewrite.spans(text, java(c), k) for k, (c, _, _) in enumerate(RULES)]), lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["stop"].alias("stop"), s["original"].alias("original")))))


def matches(found: Column) -> Column:
    """spans as matches: category, original, replacement, start, end and confidence."""
    of = lambda values: F.array(*map(F.lit, values))
    category, placeholder = of(c for c, _, _ in RULES), of(to for _, to, _ in RULES)
    return F.transform(found, lambda s: F.struct(
        F.get(category, s["rule"]).alias("category"), s["original"].alias("original"), F.get(placeholder, s["rule"]).alias("replacement"), s["start"].alias("start"), s["stop"].alias("end"), F.lit(1.0).alias("confidence"),
    ))


def scan(text: Column) -> Column:
    """matches of a text, without Python."""
    return matches(spans(text))


def redacted(text: Column, found: Column | None = None) -> Column:
    """The text without the matches (or those of `found`), as Matcher.redact gives it, without Python."""
    change = lambda every: rewrite.replaced(text, rewrite.merged(every), [to for _, to, _ in RULES])
    return rewrite.let(spans(text), change) if found is None else F.when(F.size(found) == 0, text).otherwise(change(found))


@dataclass(frozen=True)
class Match:
    category: str
    original: str
    replacement: str
    start: int
    end: int
    confidence: float = 1.0


class Matcher:
    """All rules over one text. extra: category -> pattern, with case."""

    def __init__(self, extra: dict[str, str] | None = None) -> None:
        self.rules = [(c, re.compile(p, re.I), placeholder) for c, placeholder, p in RULES]
        self.rules += [(c, re.compile(p), f"[{c.upper()}]") for c, p in (extra or {}).items()]

    def scan(self, text: str) -> list[Match]:
        """Every match of every rule, by start; overlapping ones too."""
        got = [Match(c, m[0], to, m.start(), m.end()) for c, rule, to in self.rules for m in rule.finditer(text)]
        return sorted(got, key=lambda m: m.start)

    def redact(self, text: str, compat_splice: bool = False) -> tuple[str, list[Match]]:
        """Replace matches. Of overlapping ones the leftmost, then longest, then first rule counts, and the rest of what it overlaps goes with it.

        compat_splice: each match is spliced in by its own offsets from right to left, which can eat or leave text around overlaps.
        """
        got = self.scan(text)
        if compat_splice:
            for m in reversed(got):
                text = text[: m.start] + m.replacement + text[m.end :]
            return text, got
        out, at = [], 0
        upto, pending = 0, None
        for m in sorted(got, key=lambda m: (m.start, -m.end)):
            if pending is not None and m.start < upto:
                upto = max(upto, m.end)
                continue
            if pending is not None:
                out += [text[at : pending.start], pending.replacement]
                at = upto
            pending, upto = m, m.end
        if pending is not None:
            out += [text[at : pending.start], pending.replacement]
            at = upto
        return "".join(out) + text[at:], got
