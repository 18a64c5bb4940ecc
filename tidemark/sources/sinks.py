"""What is written: trimmed recordings, cached signals with their statistics, and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import describe

#: Tables of the catalog and their keys.
CATALOG = {
    "missions": ("mission_id STRING, path STRING, robot_id STRING, start_time TIMESTAMP_NTZ, duration_s DOUBLE, size_bytes BIGINT, messages BIGINT, verdict STRING, score DOUBLE, index_version INT, indexed_at TIMESTAMP_NTZ", ["mission_id"]),
    "topics": ("mission_id STRING, topic STRING, n BIGINT, hz DOUBLE, score DOUBLE", ["mission_id", "topic"]),
    "events": ("mission_id STRING, kind STRING, topic STRING, t DOUBLE, severity INT, detail STRING", ["mission_id"]),
    "signals": ("mission_id STRING, signal_key STRING, n BIGINT, mean DOUBLE, std DOUBLE", ["mission_id", "signal_key"]),
    "tags": ("mission_id STRING, tag STRING, created_at TIMESTAMP_NTZ", ["mission_id", "tag"]),
    "log_patterns": ("mission_id STRING, template STRING, level STRING, n BIGINT", ["mission_id", "template", "level"]),
    "sources": ("root STRING, added_at TIMESTAMP_NTZ", ["root"]),
}


def create_catalog(spark: SparkSession, database: str = "default") -> None:
    for name, (columns, _) in CATALOG.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def trimmed(arrivals: DataFrame, start: float, end: float, topics: list[str] | None = None) -> DataFrame:
    """Arrivals of a window and some topics, for a new recording; write with .write.parquet()."""
    rows = arrivals.where(F.col("t").between(start, end))
    return rows.where(F.col("topic").isin(topics)) if topics else rows


def cache_signals(samples: DataFrame, folder: str) -> DataFrame:
    """Writes samples(mission_id, signal_key, t, v) of signals with two of them at least, and returns their statistics."""
    keys = ["mission_id", "signal_key"]
    stats = describe(samples, keys).where("n >= 2")
    samples.join(stats.select(*keys), keys, "left_semi").select(*keys, "t", "v").write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(folder)
    return stats


def read_signal(spark: SparkSession, folder: str, mission_id: str, signal_key: str) -> DataFrame:
    """(t, v) of one signal; only its folder is read."""
    return spark.read.parquet(folder).where((F.col("mission_id") == mission_id) & (F.col("signal_key") == signal_key)).select("t", "v").orderBy("t")


def replace_missions(rows: DataFrame, folder: str) -> None:
    """Replaces the rows of the missions that rows has, others stay: one folder for each."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mission_id").parquet(folder)
