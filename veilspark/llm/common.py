"""What the operators share: reading tables, cutting lineage in the shared folder, salting hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where none is set and everything runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"veilspark-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by cut() that nothing reads any more."""
    path = getattr(df, "_veil_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """All words of a text in order; an empty array for none or null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def hot_values(counts: DataFrame, key: str, n: str, share: float = 0.002, least: int = 1000) -> list:
    """Values of key with over `share` of all rows, and over `least`: 1 / share of them at most, whatever the input's size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > F.lit(max(least, total * share))).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """left joined to right (one row per key), with the rows of hot keys dealt over `salts` partitions by `spread`."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
