"""Document fingerprints: bottom-k sketches of shingle hashes, by built-in functions only.

A sketch is the k least distinct 64-bit hashes of a text's shingles, ascending. Sketches of parts merge into the sketch of the whole;
from two of them follow resemblance and containment, from one the number of distinct shingles.

Defined results: a text with fewer words than a shingle has its whole word sequence as its only shingle; a null, empty or blank text has an
empty sketch; two empty sketches are alike (1.0), an empty and a filled one are not (0.0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

K, SHINGLE, RANGE_CHARS = 256, 5, 32 << 20


def hashes(word_array: Column, shingle: int = SHINGLE) -> Column:
    """One hash for each shingle of an array of words. Give a column, not an expression: it is used for each shingle."""
    n = F.size(word_array)
    each = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.slice(word_array, i, shingle)))
    return F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64(word_array))).otherwise(F.array().cast("array<bigint>"))


def bottom(hash_array: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hash_array)), 1, k)


def with_sketch(df: DataFrame, text: Column, out_col: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    return df.withColumn("__w", words(text)).withColumn(out_col, bottom(hashes(F.col("__w"), shingle), k)).drop("__w")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each group of rows. The k least hashes are taken by rank in two steps, so no group is gathered in one row or task."""
    part = df.select(*keys, F.explode(sketch_col).alias("__h"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("__p")).distinct()
    near = part.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__h"))).where(F.col("__r") <= k).select(*keys, "__h").distinct()
    least = near.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("__h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else k - 1 over the share of the hash range that the k least cover."""
    covered = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / covered)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    shared = j * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits a hash, in ascending order."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(docs: DataFrame, id_col: str, text_col: str, k: int = K, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """id, text, sketch and next_text, next_sketch: of the next row by descending id, after the last one the first.

    Rows are dealt by ranges of ids (quantiles, from the id column alone), each range is ordered by itself, and the first row of
    every range is also sent to the range before it. So the text is shuffled once and no range is larger than its share.
    Rows with equal ids follow by descending text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / RANGE_CHARS))
    cuts = rows.agg(F.percentile_approx("__k", [i / n for i in range(1, n)], max(20_000, 10 * n))).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(bounds)))  # looked up in two steps, so that a row's cost grows with the root of the number of ranges
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    heads, parts = bounds[step::step], [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    under = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("__k")))
    rows = rows.withColumn("__c", under(longs(heads)))
    bucket = F.col("__c") * step + under(F.get(F.array(*[longs(p) for p in parts]), F.col("__c")))
    tops = dict(rows.groupBy(bucket.alias("b")).agg(F.max("__k")).collect())  # one for each range
    order = sorted(tops)
    guests = F.array(*[F.struct(F.lit(tops[b]).alias("k"), F.lit(order[(i + 1) % len(order)]).alias("to")) for i, b in enumerate(order)]) if order else F.array().cast("array<struct<k:bigint,to:int>>")
    here = F.array(F.struct(bucket.alias("b"), F.lit(False).alias("guest")))
    also = F.transform(F.filter(guests, lambda g: g["k"] == F.col("__k")), lambda g: F.struct(g["to"].alias("b"), F.lit(True).alias("guest")))
    dealt = rows.select("__k", "id", "text", F.inline(F.concat(here, also))).repartition("b")
    dealt = with_sketch(dealt, F.col("text"), "sketch", k, shingle)
    w = Window.partitionBy("b").orderBy("guest", F.desc("__k"), F.desc("text"))
    dealt = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return dealt.where(~F.col("guest")).select("id", "text", "sketch", "next_text", "next_sketch")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each text's sketch beside the sketch of the text whose last half is the next document's beginning."""
    df = with_next(docs, id_col, text_col, k, shingle)
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("half"))))
    df = with_sketch(df.drop("text", "next_text"), F.col("edited"), "edited_sketch", k, shingle)
    return df.select(F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
