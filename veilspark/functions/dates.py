"""Date shifting: one offset for each patient, from a keyed hash. All of it is native; Shifter is the same for Python workers."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DateShiftError
from . import rewrite

RANGE = (-365, 365)
OLDEST, YEAR, COLLAPSED = 89, 365, 90
# Formats of dates in text, in the order in which they are tried, and how they look.
FORMATS = (("%Y-%m-%d", r"\b(\d{4}-\d{2}-\d{2})\b"), ("%m/%d/%Y", r"\b(\d{2}/\d{2}/\d{4})\b"), ("%m-%d-%Y", r"\b(\d{2}-\d{2}-\d{4})\b"), ("%Y%m%d", r"\b(\d{8})\b"))
#: A date followed by a time, as in 2025-03-15T10:30:00; \b alone sees no end of the date there.
TIMED = r"\b(\d{4}-\d{2}-\d{2})(?=T\d{2}:)"


def check(salt: str, shift_range: tuple[int, int] = RANGE) -> None:
    if not salt or not salt.strip():
        raise ValueError("date shifting needs a secret salt of your own")
    if shift_range[1] <= shift_range[0]:
        raise DateShiftError(f"range of offsets {shift_range} is empty")


def offset(patient: Column, salt: str, shift_range: tuple[int, int] = RANGE) -> Column:
    """Days, equal for equal patients."""
    check(salt, shift_range)
    low, high = shift_range
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), patient.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return (F.lit(low) + F.pmod(number, F.lit(high - low + 1))).cast("int")


def shift_date(date: Column, days: Column) -> Column:
    """Null where the result would leave the years 1 to 9999."""
    moved = F.unix_date(date.cast("date")) + days
    return F.when(moved.between(-719162, 2932896), F.date_from_unix_date(moved))


def shift_timestamp(ts: Column, days: Column) -> Column:
    """The time of day stays."""
    return ts + F.make_dt_interval(days=days)


def collapse_age(birth: Column, reference: Column) -> Column:
    """Above 89 years (of 365 days) a birth date becomes that of 90 years."""
    days = F.datediff(reference, birth)
    return F.when(F.floor(days / YEAR) > OLDEST, F.date_sub(reference, COLLAPSED * YEAR)).otherwise(birth)


JAVA = {"%Y-%m-%d": "yyyy-MM-dd", "%m/%d/%Y": "MM/dd/yyyy", "%m-%d-%Y": "MM-dd-yyyy", "%Y%m%d": "yyyyMMdd"}
#: Parts of a leniently written date, as strptime reads them: the first alternative that fits counts.
_LENIENT = {"%Y": r"(\d{4})", "%m": r"(1[0-2]|0[1-9]|[1-9])", "%d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"}


def _moved(date: Column, form: str, days: Column) -> Column:
    """The shifted date in the form; null for no date, or one that the shift takes out of the years 1 to 9999."""
    return F.date_format(F.when(F.unix_date(date) >= -719162, shift_date(date, days)), JAVA[form])


def _whole(text: Column, days: Column) -> Column:
    """A text that is one date, its parts written with fewer digits or not, shifted; else null."""
    tries = []
    for form, _ in FORMATS:
        rule, order = "(?sU)^" + re.escape(form), re.findall("%.", form)
        for part, pattern in _LENIENT.items():
            rule = rule.replace(re.escape(part), pattern)
        of = {part: F.trim(F.regexp_extract(text, rule + "(.*)$", k + 1)) for k, part in enumerate(order)}
        date = F.try_to_date(F.concat(of["%Y"], F.lit("-"), F.lpad(of["%m"], 2, "0"), F.lit("-"), F.lpad(of["%d"], 2, "0")), "yyyy-MM-dd")
        tries.append(F.when(F.rlike(text, F.lit(rule + "$")) & (F.regexp_extract(text, rule + "(.*)$", 4) == ""), _moved(date, form, days)))
    return F.coalesce(*tries)


def shifted(df: DataFrame, texts: str, days: str, out: str, timed: bool = True, whole_values: bool = True) -> DataFrame:
    """df with out: (text, n), a text with its dates shifted and their number, as Shifter.value gives them, without Python; for an array of texts an array of these. Null days shift nothing.

    Each format of dates is a projection of its own over what the one before left, so that no expression grows with their number. A text without digits in that form costs one test.
    """
    many = dict(df.dtypes)[texts].startswith("array")
    each = lambda c, f: F.transform(c, f) if many else f(F.col(c) if isinstance(c, str) else c)
    df = df.withColumn(out, each(texts, lambda t: F.struct(t.alias("text"), F.lit(0).alias("n"))))
    for form, pattern in ([("%Y-%m-%d", TIMED)] if timed else []) + list(FORMATS):
        moved = lambda m, form=form: _moved(F.try_to_date(m, JAVA[form]), form, F.col(days))
        change = (lambda moved: lambda m: moved(m))(moved)
        df = df.withColumn(out, each(out, (lambda p, c: lambda x: rewrite.each_match(x["text"], x["n"], p, c))("(?U)" + pattern, change)))
    if not whole_values:
        return df
    # A whole value that is a date has at most ten characters but for white space around it.
    form = F.lit(rewrite.as_java(r"^\s*\d[\d/ -]{4,9}\s*\z"))

    def lenient(x: Column) -> Column:
        one = _whole(F.regexp_replace(x["text"], rewrite.as_java(r"^\s+|\s+\z"), ""), F.col(days))
        return F.when((x["n"] == 0) & F.rlike(x["text"], form), one)

    df = df.withColumn("__whole", each(out, lenient))
    both = lambda x, w: F.struct(F.coalesce(w, x["text"]).alias("text"), (x["n"] + w.isNotNull().cast("int")).alias("n"))
    return df.withColumn(out, F.zip_with(out, "__whole", both) if many else both(F.col(out), F.col("__whole"))).drop("__whole")


class Shifter:
    """Dates inside text, for Python workers. timed: also shift dates that a time follows (False: leave them, as plain word bounds do)."""

    def __init__(self, timed: bool = True, whole_values: bool = True) -> None:
        self.rules = [(f, re.compile(p)) for f, p in FORMATS]
        if timed:
            self.rules.insert(0, ("%Y-%m-%d", re.compile(TIMED)))
        self.whole_values = whole_values

    @staticmethod
    def _moved(text: str, form: str, days: int) -> str | None:
        try:
            d = datetime.strptime(text, form) + timedelta(days=days) if text.isascii() else None
        except (ValueError, OverflowError):
            return None
        if d is None:
            return None
        return d.strftime(form.replace("%Y", f"{d.year:04d}"))

    def text(self, text: str, days: int) -> tuple[str, int]:
        n = 0

        def one(m: re.Match, form: str) -> str:
            nonlocal n
            new = self._moved(m[1], form, days)
            n += new is not None
            return m[0] if new is None else new

        for form, rule in self.rules:
            text = rule.sub(lambda m, form=form: one(m, form), text)
        return text, n

    def value(self, text: str, days: int) -> tuple[str, int]:
        """A whole string value: dates in it, else the value itself if it reads as a date with leniently written parts."""
        new, n = self.text(text, days)
        if n or not self.whole_values:
            return new, n
        for form, _ in FORMATS:
            moved = self._moved(text.strip(), form, days)
            if moved is not None:
                return moved, 1
        return text, 0
