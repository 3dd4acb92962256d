"""Line dedup by site-relative frequency, by built-in functions only.

For each host, a line's ratio is the share of the host's other pages that have it. Lines above `ratio` are boilerplate and dropped from every page of the host. To
the other pages PRIOR pages without the line are added, since a line that two of a site's ten pages share says little; a line of a single page is never boilerplate.

    ratio(line, host) = (pages of the host with the line - 1) / (pages of the host - 1 + PRIOR)

A host's boilerplate is at most (mean lines of a page) / ratio lines; it is kept as 128-bit hashes and joined to pages by host. Lines are counted by host and line, so a host's lines are spread
over all tasks, and hot hosts are salted where they are joined.

Defined results: null text stays null, empty stays empty; blank lines are never dropped; a null host is a host of its own; repeated rows are
kept and count as a page each; a line counts once a page; extra columns pass; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_values, salted_join

RATIO, PRIOR = 0.02, 50


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without port and user; null where there is none."""
    found = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.when(found != "", F.lower(found))


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _has_word(line: Column) -> Column:
    return F.translate(line, " \t\n\x0b\f\r", "") != ""


def boilerplate(pages: DataFrame, ratio: float = RATIO, prior: float = PRIOR) -> DataFrame:
    """pages (key, text) -> key, pages, marks: the hashes of each host's boilerplate lines (hosts without any are absent)."""
    pages = pages.where("text is not null")
    total = pages.groupBy("key").agg(F.count("*").alias("pages"))  # a row for each host
    marks = F.transform(F.array_distinct(F.filter(F.split("text", "\n"), _has_word)), _mark)
    lines = pages.select("key", F.explode(marks).alias("m")).groupBy("key", "m").agg(F.count("*").alias("n")).where("n > 1")
    hot = hot_values(total, "key", "pages", least=200)
    common = salted_join(lines, total, "key", hot, F.col("m.a"), how="inner").where(F.col("n") - 1 > ratio * (F.col("pages") - 1 + prior))
    return common.groupBy("key").agg(F.max("pages").alias("pages"), F.collect_list("m").alias("marks"))


def dedup_lines(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, prior: float = PRIOR) -> DataFrame:
    """docs with text_col freed of boilerplate lines, and n_lines, n_dropped."""
    keyed = docs.withColumn("__key", F.coalesce(F.concat(F.lit("0"), host), F.lit("1")))
    found = cut(boilerplate(keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), ratio, prior), "lines")
    hot = hot_values(found.withColumnRenamed("key", "__key"), "__key", "pages", least=200)
    out = salted_join(keyed, found.select(F.col("key").alias("__key"), F.col("marks").alias("__marks")), "__key", hot, F.xxhash64(F.col(text_col)))
    out = out.withColumn("__lines", F.split(text_col, "\n"))
    kept = F.filter("__lines", lambda x: ~(_has_word(x) & F.array_contains(F.col("__marks"), _mark(x))))
    out = out.withColumn("__kept", F.when(F.col("__marks").isNull(), F.col("__lines")).otherwise(kept))
    n = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    out = out.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long"),
        "n_dropped": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n - F.size("__kept")).cast("long"),
        text_col: F.array_join("__kept", "\n"),
    })
    return out.drop("__key", "__marks", "__lines", "__kept")
