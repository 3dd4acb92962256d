"""De-identification of streams. Offsets are hashes, so no layer keeps state, and a stream is shifted as a table is."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, phi


def shifted(events: DataFrame, salt: str, patient: str = "user_id", at: str = "ts") -> DataFrame:
    return events.withColumn(at, dates.shift_timestamp(F.col(at), dates.offset(F.col(patient), salt)))


def redacted(events: DataFrame, text_col: str, categories: tuple[str, ...] = ("EMAIL", "PHONE", "IP_ADDRESS", "URL")) -> DataFrame:
    """Single rules one after another in the JVM."""
    for c in categories:
        events = events.withColumn(text_col, phi.replace(F.col(text_col), c))
    return events


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def run_once(spark: SparkSession, sf_dir: str, salt: str) -> DataFrame:
    """All events that are there now, through a stream into a table in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    out = os.path.join(base, f"veilspark-stream-{uuid.uuid4().hex}")
    one = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(one.schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    q = shifted(stream, salt).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shifted")).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")
