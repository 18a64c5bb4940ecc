"""The tables of the star schema, and the events table seen as arrivals."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
KEYS = ("mission_id", "topic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # so that workers find the package from any folder
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relative(rows: DataFrame) -> DataFrame:
    """Adds t, seconds since the first arrival of the mission; us are microseconds."""
    first = rows.groupBy("mission_id").agg(F.min("us").alias("_t0"))
    return rows.join(first, "mission_id").withColumn("t", (F.col("us") - F.col("_t0")) / F.lit(1e6)).drop("_t0")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mission_id, topic, seq, us, t, v, k, user_id): a month is a mission and an event type a topic."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return relative(e.select(F.date_format("ts", "yyyy-MM").alias("mission_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), us.alias("us"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id"))
