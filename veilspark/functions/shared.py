"""Cutting lineage between rounds of an iteration, and folders for what is written on the way."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str = "") -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one only where that is unset and everything runs on this machine, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"veilspark-{uuid.uuid4().hex}{name}")


def settle(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores if its sources have so few bytes that Spark reads them in fewer tasks than there are cores; a few bytes of a compressed file can be a million rows. Larger tables stay where they lie."""
    spark = df.sparkSession
    if df.isStreaming:
        return df
    leaves, cores = df._jdf.queryExecution().optimizedPlan().collectLeaves(), spark.sparkContext.defaultParallelism
    size = sum(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size()))
    return df.repartition(2 * cores) if size < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else df


@contextmanager
def text_file(path: str) -> Iterator[Callable[[str], None]]:
    """A function that appends to a new file in whatever store Spark can write; it replaces an old one."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    held: list[str] = []

    def flush() -> None:
        out.write(bytearray("".join(held).encode()))
        held.clear()

    def write(text: str) -> None:
        held.append(text)
        if len(held) >= 1000:
            flush()

    try:
        yield write
        flush()
    finally:
        out.close()


def json_file(rows: DataFrame, line: Column, path: str, head: str, tail: str) -> None:
    """A new file: head, a line of JSON for each row in the rows' order, with commas between, and tail; it replaces an old one. Tasks write the lines beside it, and the driver's JVM appends their bytes, a buffer at a time; no row comes to the driver."""
    spark = rows.sparkSession
    hadoop, parts = spark._jvm.org.apache.hadoop, f"{path}-parts-{uuid.uuid4().hex}"
    at, where = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        rows.select(F.concat(F.lit(","), line).alias("value")).write.option("compression", "none").text(parts)
        out, first = fs.create(at, True), True
        try:
            out.write(bytearray(head.encode()))
            for part in sorted((s.getPath() for s in fs.listStatus(where) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
                source = fs.open(part)
                try:
                    # Each line begins with a comma; the first has none before it.
                    source.seek(int(first))
                    hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
                fs.delete(part, False)
                first = False
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
    finally:
        fs.delete(where, True)


def iso(at: Column) -> Column:
    """A time as ISO text in the session's zone, without a fraction that is zero."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def read_text(path: str) -> str:
    """A file of any store, whole."""
    return SparkSession.active().read.text(path, wholetext=True).first()[0]
