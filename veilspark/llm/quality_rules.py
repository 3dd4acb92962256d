"""Quality rules with adaptive thresholds, by built-in functions only.

Each text is measured. For every language and source a mergeable quantile sketch of each measure is kept: counts of values in buckets whose bounds grow
by 2 %, so sketches add up exactly and in any order. A group's sketch is merged with that of its language, weighted as PRIOR rows, and a language's before that with the sketch of all rows, so a
threshold leans on its own rows as far as there are any: at every size, without a switch. The fence of a measure is the merged sketch's median plus `REACH` times the distance
from lower quartile to median, plus a least spread. Rows over a fence are not kept. Junk below half of a group does not move its fence much.

Defined results: a null, empty or blank text has zero counts and base_failed; null language or source is a group of its own; repeated rows count
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_values, salted_join, words

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GROWTH = 1.02
REACH, PRIOR = 6.0, 50.0
#: Measure -> least spread above the median.
SPREAD = {"m_length": 1.5, "m_symbols": 0.1, "m_lines": 0.35, "m_repeats": 0.35, "m_shout": 0.15}


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(df: DataFrame, word_col: str, out_col: str, window: int = 3) -> DataFrame:
    """Words of word_col that lie in a window of words found twice or more in the same text."""
    w, n = F.col(word_col), F.size(word_col) - (window - 1)
    df = df.withColumn("__h", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, window)))))
    some = F.size("__h") > F.size(F.array_distinct("__h"))
    df = df.withColumn("__s", F.when(some, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
    spots = F.flatten(F.transform(twice, lambda x: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda d: x["i"] + d)))
    return df.withColumn(out_col, F.coalesce(F.size(F.array_distinct(spots)), F.lit(0)).cast("long")).withColumn(out_col, F.greatest(out_col, F.lit(0))).drop("__h", "__s")


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    df = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("w", words(F.col("text")))
    df = repeated_words(df, "w", "n_repeat_words")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: without(x, BLANK) != ""))
    solid = without(F.col("text"), BLANK)
    df = df.select(
        "id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        (F.length("text") - F.length(without(F.col("text"), UPPER + "!"))).cast("long").alias("n_shout"),
    )
    each = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "*", (F.col("word_chars") / each).alias("m_length"), (F.col("n_symbols") / each).alias("m_symbols"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("m_lines"),
        (F.col("n_repeat_words") / each).alias("m_repeats"), (F.col("n_shout") / F.greatest(F.col("word_chars"), F.lit(1))).alias("m_shout"),
    )


def bucket(value: Column) -> Column:
    """Of a value from 0 up: -10000 for 0, else the power of GROWTH that covers it."""
    return F.when(value <= 1e-9, F.lit(-10_000)).otherwise(F.ceil(F.log(value) / F.log(F.lit(GROWTH))).cast("int"))


def value_of(b: Column) -> Column:
    return F.when(b == -10_000, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), b - 0.5))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, b, n: rows of each bucket."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in SPREAD])
    return measured.select(*keys, F.inline(pairs)).groupBy(*keys, "measure", "b").agg(F.count("*").alias("n"))


def merged(own: DataFrame, above: DataFrame, keys: list[str], join: list[str], prior: float = PRIOR) -> DataFrame:
    """own (keys, measure, b, n) with above's (join, measure, b, share) added as `prior` rows -> keys, measure, b, share: the merged sketch, whose shares sum to one; and rows, own's number."""
    rows = own.groupBy(*keys, "measure").agg(F.sum("n").alias("rows"))
    every = rows.join(above, [*join, "measure"])  # as many rows for a group as there are buckets
    total = F.col("rows") + F.lit(prior)
    both = every.join(own.select(*keys, "measure", "b", "n"), [*keys, "measure", "b"], "left")
    return both.select(*keys, "measure", "b", "rows", ((F.coalesce("n", F.lit(0)) + F.lit(prior) * F.col("share")) / total).alias("share"))


def fences(sketch: DataFrame, keys: list[str], reach: float = REACH) -> DataFrame:
    """keys, rows and one fence a measure, from merged sketches."""
    s = sketch.withColumn("upto", F.sum("share").over(Window.partitionBy(*keys, "measure").orderBy("b")))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q - 1e-9, F.col("b")))
    per = s.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), value_of(quantile(0.25)).alias("q1"), value_of(quantile(0.5)).alias("q2"))
    spread = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in SPREAD.items()])
    fence = F.col("q2") + F.lit(reach) * (F.col("q2") - F.col("q1")) + spread
    return per.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == m, fence)).alias(f"f_{m}") for m in SPREAD])


def thresholds(measured: DataFrame, prior: float = PRIOR, reach: float = REACH) -> DataFrame:
    """measured (lk, key, measures) -> key, rows and the fences of each language and source."""
    by_group = cut(sketches(measured, ["lk", "key"]), "rulesketch")
    by_lang = by_group.groupBy("lk", "measure", "b").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "b").agg(F.sum("n").alias("n"))
    whole = by_all.join(by_all.groupBy("measure").agg(F.sum("n").alias("t")), "measure").select("measure", "b", (F.col("n") / F.col("t")).alias("share"))
    langs = cut(merged(by_lang, whole, ["lk"], [], prior).drop("rows"), "rulelangs")
    return fences(merged(by_group, langs, ["lk", "key"], ["lk"], prior), ["lk", "key"], reach).drop("lk")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = PRIOR, reach: float = REACH) -> DataFrame:
    """One row per row of docs: id, counts, base_failed, kept."""
    m = cut(measures(docs, id_col, text_col, lang_col, source_col), "rules")
    part = lambda c: F.coalesce(F.concat(F.lit("0"), F.col(c)), F.lit("1"))
    m = m.withColumn("lk", part("lang")).withColumn("key", F.concat(F.col("lk"), F.lit("\x00"), part("source")))
    limits = cut(thresholds(m, prior, reach), "rulefences")
    out = salted_join(m, limits, "key", hot_values(limits, "key", "rows", least=200), F.xxhash64("id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.greatest(*[(F.col(x) > F.col(f"f_{x}")).cast("int") for x in SPREAD]) == 1
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~over).alias("kept"))
