"""Finding and replacing in text by expressions alone: matches and the gaps between them, zipped back.

Spark has no function that gives where a pattern matches. But all matches of a text and the pieces between them, each by one built-in, alternate; so their lengths, summed up, are the places, and joined in turn they are the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A match: from start up to stop in characters, the number of its rule, and its text.
SPANS = "array<struct<start:int,stop:int,rule:int,original:string>>"
#: A JSON string with its quotes. Possessive, so that long strings need no stack.
JSON_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def as_java(pattern: str) -> str:
    """A pattern of Python's for Spark: Unicode classes, and white space with the four separators that Java leaves out."""
    inside, out = False, []
    for token in re.findall(r"\\.|.", pattern, re.S):
        inside = token == "[" or inside and token != "]"
        out.append((r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]") if token == r"\s" else token)
    return "(?U)" + "".join(out)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def none() -> Column:
    return F.array().cast(SPANS)


def spans(text: Column, pattern: str, rule: int, group: int = 0, ahead: bool = False) -> Column:
    """Every match of the pattern, or of a group that ends where the match ends (ahead: that begins there, in a lookahead). A text without any costs one test."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    if group:
        found = F.zip_with(whole, F.regexp_extract_all(text, p, F.lit(group)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    else:
        found = F.transform(whole, lambda m: F.struct(m.alias("m"), m.alias("g")))
    # One gap more than there are matches: after the last nothing is added.
    turns = F.zip_with(F.split(text, pattern, -1), found, lambda gap, f: F.struct(gap.alias("gap"), f.alias("f")))

    def step(acc: Column, t: Column) -> Column:
        stop = acc["at"] + F.length(t["gap"]) + F.coalesce(F.length(t["f"]["m"]), F.lit(0))
        size = F.length(t["f"]["g"])
        one = F.struct((stop if ahead else stop - size).alias("start"), (stop + size if ahead else stop).alias("stop"), F.lit(rule).alias("rule"), t["f"]["g"].alias("original"))
        return F.struct(stop.alias("at"), F.when(t["f"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    all_ = F.aggregate(turns, F.struct(F.lit(0).alias("at"), none().alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, p), all_).otherwise(none())


def merged(found: Column) -> Column:
    """Stretches apart from each other: the leftmost match, then the longest, then that of the first rule names one, and whatever overlaps it goes with it."""
    kind = "array<struct<start:int,stop:int,rule:int>>"
    turns = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["rule"].alias("rule"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["start"].alias("start"), F.greatest(last["stop"], -s["back"]).alias("stop"), last["rule"].alias("rule"))
        new = F.struct(s["start"].alias("start"), (-s["back"]).alias("stop"), s["rule"].alias("rule"))
        return F.when(s["start"] < last["stop"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(turns, F.array().cast(kind), step)


def replaced(text: Column, stretches: Column, by: list[str]) -> Column:
    """text with each stretch, in order and apart, replaced by what its rule says."""
    words = F.array(*map(F.lit, by))

    def built(c: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(c, i - 1)["stop"], F.lit(0))
        parts = F.transform(c, lambda x, i: F.concat(F.substr(text, upto(i) + 1, x["start"] - upto(i)), F.get(words, x["rule"])))
        return F.concat(F.array_join(parts, ""), F.substr(text, upto(F.size(c)) + 1, F.length(text)))

    return let(stretches, lambda c: F.when(F.size(c) == 0, text).otherwise(built(c)))


def each_match(text: Column, n: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """(text, n): every match replaced by change(match) where that is not null; n grows by their number."""

    def joined(parts: Column) -> Column:
        return F.struct(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), (n + F.size(F.filter(parts, lambda x: x["c"]))).alias("n"))

    new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), change(m).alias("to")))
    parts = F.zip_with(F.split(text, pattern, -1), new, lambda gap, x: F.struct(F.concat(gap, F.coalesce(x["to"], x["m"], F.lit(""))).alias("t"), x["to"].isNotNull().alias("c")))
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, joined)).otherwise(F.struct(text.alias("text"), n.alias("n")))


def json_strings(json: Column) -> Column:
    """Every string of a JSON text in order: literal, gap (what follows it) and value (null for keys). The text is head(json), then all literals and gaps in turn."""
    gaps = F.split(json, JSON_STRING, -1)

    def one(gap: Column, literal: Column) -> Column:
        escaped = F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")
        value = F.when(F.contains(literal, F.lit("\\")), escaped).otherwise(F.substr(literal, F.lit(2), F.length(literal) - 2))
        return F.struct(literal.alias("literal"), gap.alias("gap"), F.when(~F.rlike(gap, F.lit(r"^\s*:")), value).alias("value"))

    # All but the first; a text has no more strings than that.
    return F.zip_with(F.slice(gaps, 2, 1 << 30), F.regexp_extract_all(json, F.lit(JSON_STRING), F.lit(0)), one)


def joined_json(json: Column, strings: Column, new: Column) -> Column:
    """The JSON text with another value for each string for which the array `new` has one, and then without blanks between its parts; the same text if there is none."""
    tight = lambda gap: F.regexp_replace(gap, r"\s+", "")

    def literal(s: Column, v: Column) -> Column:
        made = F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.concat(F.coalesce(F.nullif(made, F.lit("")), s["literal"]), tight(s["gap"]))

    changed = F.concat(tight(F.get(F.split(json, JSON_STRING, 2), 0)), F.array_join(F.zip_with(strings, new, literal), ""))
    return F.when(F.exists(new, lambda v: v.isNotNull()), changed).otherwise(json)
