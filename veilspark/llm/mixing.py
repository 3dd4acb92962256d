"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each document has a fixed 48-bit hash. A source's target is its size times a rate: the whole part is taken of every
document, the rest by one more copy of the documents whose hash lies under a threshold. The threshold comes from a histogram of words by
source and hash bucket: running sums find the bucket in which the budget ends, and only that bucket's documents are summed again in finer
buckets, `LEVELS` times. Nothing is sorted by document. Thresholds nest: a larger target takes a superset.

Defined results: null or blank text has size 0; a null source is a source of its own, after all others; repeated
rows each count and are taken alike; ids may be null; an empty table gives an empty result; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hot_values, salted_join

STEP, LEVELS = 12, 4
HASH_BITS = STEP * LEVELS


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (key, size) by document -> key, source_size, target: shares of budget by repeating weights in key order, none above most x its size."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(most)))
    # Sources fill up in the order of top / w: one is full if its top is under the level that all left would share.
    by_fill = Window.orderBy(F.col("top") / F.col("w"), "key")
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    per = per.withColumns({
        "all_size": F.sum("source_size").over(every) * F.lit(float(budget)),
        "full_before": F.coalesce(F.sum("top").over(before), zero),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero),
    })
    per = per.withColumn("full", F.col("top") * F.col("w_left") <= (F.col("all_size") - F.col("full_before")) * F.col("w"))
    of = lambda c, full: F.coalesce(F.sum(F.when(F.col("full") == full, F.col(c))).over(every), zero)
    level = (F.col("all_size") - of("top", True)) / F.greatest(of("w", False), F.lit(1e-300))
    return per.withColumn("level", level).select("key", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.least("top", F.col("w") * F.col("level"))).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """sized (key, size, h), aims (key, rest, n) -> key, limit: hashes under it hold about rest words."""
    hot = hot_values(aims, "key", "n", least=200)
    open_ = aims.select("key", "rest", F.lit(0).cast("long").alias("prefix"))
    width = 1 << STEP
    for level in range(1, LEVELS + 1):
        bits = STEP * level
        b = F.shiftright("h", HASH_BITS - bits)
        inside = salted_join(sized.select("key", "size", "h", b.alias("b")), open_, "key", hot, F.col("h"), how="inner")
        if level > 1:
            inside = inside.where(F.shiftright("b", STEP) == F.col("prefix"))
        sums = inside.groupBy("key", "b").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("b"))
        ends = sums.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("n"))
        # The bucket in which the budget ends; where all buckets fit, the place after the last.
        edge = ends.where("upto > rest").groupBy("key").agg(F.min_by(F.struct("b", "under", "upto"), "b").alias("e"))
        found = open_.join(edge, "key", "left")
        past = (F.col("prefix") + 1) * width
        if level < LEVELS:
            done = F.col("e").isNull()
            nxt = found.select("key", F.when(done, past - 1).otherwise(F.col("e.b")).alias("prefix"), F.when(done, F.lit(1e300)).otherwise(F.col("rest") - F.col("e.under")).alias("rest"))
        else:
            take = (F.col("e.upto") - F.col("rest")) < (F.col("rest") - F.col("e.under"))  # the nearer side of the last bucket
            nxt = found.select("key", F.when(F.col("e").isNull(), past).otherwise(F.col("e.b") + take.cast("long")).alias("limit"))
        open_ = cut(nxt, "mixlimit")
    return open_


def _sized(docs: DataFrame, text_col: str, source_col: str, id_col: str) -> dict:
    """Columns that the mix is made from: the source's key, the size and the hash of a document."""
    return {
        "key": F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "h": F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long"),
    }


def plan(sized: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized (key, size, h) -> a row for each source: key, source_size, target, whole, limit, n (its documents)."""
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    aims = targets(sized, weights, budget, most).join(sized.groupBy("key").agg(F.count("*").alias("n")), "key")
    aims = cut(aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mixaims")
    return cut(aims.join(thresholds(sized, aims), "key"), "mixplan")


def copies(most: float = 2.0) -> Column:
    """How often the mix has a document, from its hash and its source's plan."""
    extra = (F.col("h") < F.col("limit")).cast("long")
    return F.least(F.col("whole") + extra, F.lit(int(most)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes: 0, 1 or 2 copies of the size)."""
    of = _sized(docs, text_col, source_col, id_col)
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *[c.alias(k) for k, c in of.items()]), "mixsizes")
    found = plan(sized, weights, budget, most)
    joined = salted_join(sized, found, "key", hot_values(found, "key", "n", least=200), F.col("h"), how="inner")
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (copies(most) * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix has it. Texts are not shuffled while the sources' plan is small enough to broadcast."""
    own, of = docs.columns, _sized(docs, text_col, source_col, id_col)
    keyed = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), *[c.alias(k) for k, c in of.items()])
    found = plan(cut(keyed.select("key", "size", "h"), "mixsizes"), weights, budget, most)
    joined = salted_join(keyed.drop("size"), found, "key", hot_values(found, "key", "n", least=200), F.col("h"), how="inner")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies(most).cast("int")))).select("row.*")
