"""Looking into one recording: its topics and schemas, samples, one message, and figures of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clock import decimated
from tidemark.operators.redact import hidden
from tidemark.operators.series import describe
from tidemark.sources.datasource import register, resolved

#: Messages of a topic that samples are taken from, and how many.
FIRST, SAMPLES = 2001, 20


def _read(spark: SparkSession, path: str, roots: list[str] | None, **options: str) -> DataFrame:
    resolved(path, roots)
    register(spark)
    return spark.read.format("recording").options(path=path, **options).load()


def list_topics(spark: SparkSession, path: str, roots: list[str] | None = None, hide: list[str] = ()) -> DataFrame:
    out = _read(spark, path, roots, what="topics")
    return out.where(~hidden(F.col("topic"), list(hide))) if hide else out


def topic_schema(spark: SparkSession, path: str, topic: str, roots: list[str] | None = None) -> DataFrame:
    return _read(spark, path, roots, what="schemas").where(F.col("topic") == topic)


def messages(spark: SparkSession, path: str, topic: str, roots: list[str] | None = None) -> DataFrame:
    """Decoded messages of a topic with t, seconds since its first one; those that don't decode have no payload."""
    rows = _read(spark, path, roots, decode="true").where((F.col("topic") == topic) & F.col("error").isNull())
    first = rows.agg(F.min("log_time_ns").alias("_f"))
    return rows.crossJoin(F.broadcast(first)).withColumn("t", (F.col("log_time_ns") - F.col("_f")) / F.lit(1e9)).drop("_f")  # one row


def sample_messages(spark: SparkSession, path: str, topic: str, n: int = SAMPLES, roots: list[str] | None = None) -> DataFrame:
    """Up to n messages, evenly spaced over the first ones."""
    rows = messages(spark, path, topic, roots).orderBy("log_time_ns", "seq").limit(FIRST)
    return decimated(rows, ["topic"], ["log_time_ns", "seq"], max(2, n))


def get_message_at(spark: SparkSession, path: str, topic: str, t: float, within: float = 2.0, roots: list[str] | None = None) -> DataFrame:
    """The message nearest to a time, the earliest of equals, if one is near enough."""
    near = F.abs(F.col("t") - t)
    return messages(spark, path, topic, roots).where(near <= within).orderBy(near, "log_time_ns", "seq").limit(1)


def field(rows: DataFrame, path: str) -> DataFrame:
    """(topic, t, v) of a numeric field, a dotted path with [n] for places of arrays; rows without a number are left out."""
    return rows.select("topic", "t", F.get_json_object("payload", f"$.{path}").try_cast("double").alias("v")).where("v is not null")


def field_stats(spark: SparkSession, path: str, topic: str, name: str, roots: list[str] | None = None, secret: list[str] = ()) -> DataFrame:
    """describe() of a field; a field that is to be hidden is refused."""
    if any(name == s or name.startswith(f"{s}.") or f".{s}." in f".{name}." for s in secret):
        raise PermissionError(f"{name} is hidden")
    return describe(field(messages(spark, path, topic, roots), name), ["topic"])
