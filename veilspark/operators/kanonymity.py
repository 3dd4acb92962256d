"""k-anonymity and l-diversity over any DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import KAnonymityError
from ..functions.shared import settle

#: The share of rows from which a class is dealt out, and over how many partitions.
HOT, SALTS = 0.002, 32


@dataclass(frozen=True)
class Rule:
    """How a quasi-identifier is generalised: "range" with a step, "prefix" with a length, or "suppress"."""

    kind: str
    size: int = 10


def by_range(value: Column, step: int) -> Column:
    """"20-24" for 23.7 and step 5; a number is cut towards zero first, text that is no number stays, null stays null."""
    n = value.try_cast("double")
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    low = F.floor(whole / F.lit(step)) * step
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 9e15)
    return F.when(usable, F.concat(low.cast("bigint").cast("string"), F.lit("-"), (low + (step - 1)).cast("bigint").cast("string"))).otherwise(value.cast("string"))


def by_prefix(value: Column, length: int) -> Column:
    return F.substring(value.cast("string"), 1, length)


def generalise(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    make = {"range": by_range, "prefix": by_prefix, "suppress": lambda c, _: F.lit("*")}
    for name, rule in rules.items():
        if name in df.columns:
            df = df.withColumn(name, make[rule.kind](F.col(name), rule.size))
    return df


def classes(df: DataFrame, quasi: list[str]) -> DataFrame:
    """Equivalence classes and their sizes; null is a value."""
    return df.groupBy(*quasi).agg(F.count("*").alias("class_size"))


def violations(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    return classes(df, quasi).where(F.col("class_size") < k)


def check(df: DataFrame, quasi: list[str], k: int) -> bool:
    """True, or KAnonymityError with the number of small classes and the smallest. Without any of the columns: True."""
    if k < 2:
        raise ValueError("k must be at least 2")
    quasi = [q for q in quasi if q in df.columns]
    if not quasi:
        return True
    n, least = violations(df, quasi, k).agg(F.count("*"), F.min("class_size")).first()
    if n:
        raise KAnonymityError(f"{n} equivalence class(es) have fewer than {k} rows; the smallest has {least}")
    return True


def enforce(df: DataFrame, quasi: list[str], k: int, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Generalise, then keep the rows of classes of k or more.

    Class sizes are counted once, with map-side sums, kept as a table and joined back, with the rows of large classes dealt over SALTS partitions, so a huge class is not one task's.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    df = generalise(df, rules or {})
    quasi = [q for q in quasi if q in df.columns]
    if not quasi:
        return df
    hashed = F.xxhash64(*[F.col(f"`{q}`") for q in quasi])
    big = settle(classes(df, quasi).where(F.col("class_size") >= k).withColumn("__h", hashed))
    total = big.agg(F.sum("class_size")).first()[0] or 0
    hot = [r[0] for r in big.where(F.col("class_size") > max(1000, total * HOT)).select("__h").collect()]  # 1 / HOT of them at most
    is_hot = F.col("__h").isin(hot) if hot else F.lit(False)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    big = big.select("__h", F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))).alias("__s"), *[F.col(f"`{q}`").alias(f"__q{i}") for i, q in enumerate(quasi)])
    # Of the row and the partition it was read in, so that equal rows are dealt out too.
    deal = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))], F.spark_partition_id())
    rows = df.withColumn("__h", hashed).withColumn("__s", F.when(is_hot, F.pmod(deal, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    same = [rows[q].eqNullSafe(big[f"__q{i}"]) for i, q in enumerate(quasi)]
    return rows.join(big, [rows["__h"] == big["__h"], rows["__s"] == big["__s"], *same], "left_semi").drop("__h", "__s")


def enforce_by_window(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """The same with a window; for inputs whose classes are all small."""
    w = Window.partitionBy(*quasi)
    return df.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= k).drop("__n")


def diversity(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Distinct sensitive values of each class; null is none."""
    return df.groupBy(*quasi).agg(F.count_distinct(sensitive).alias("n_sensitive"))


def check_diversity(df: DataFrame, quasi: list[str], sensitive: str, l: int) -> bool:  # noqa: E741
    quasi = [q for q in quasi if q in df.columns]
    if not quasi or sensitive not in df.columns:
        return True
    n, least = diversity(df, quasi, sensitive).where(F.col("n_sensitive") < l).agg(F.count("*"), F.min("n_sensitive")).first()
    if n:
        raise KAnonymityError(f"{n} equivalence class(es) have fewer than {l} values of {sensitive}; the least has {least}")
    return True
