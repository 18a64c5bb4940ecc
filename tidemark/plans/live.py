"""Queries of sources, streams and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EVENTS as C
from tidemark.operators import frames
from tidemark.plans.detect import K, chain
from tidemark.sources import recordings
from tidemark.sources.events import KEYS, ROOT, arrivals, table
from tidemark.sources.tables import fresh_folder
from tidemark.streaming import monitor


def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps as a stream of the events sees them end or grow; times count from the beginning of the month."""
    e = table(spark, d, "events")
    raw = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (us - F.unix_micros(F.date_trunc("month", "ts").cast("timestamp"))) / F.lit(1e6)
    rows = raw.select(F.date_format("ts", "yyyy-MM").alias("mission_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), us.alias("us"), t.alias("t"))
    out = fresh_folder(spark)
    q = monitor.gaps_of(rows, C).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.schema("mission_id string, topic string, t_start double, t_end double, period double, n long").parquet(f"{out}/rows")
    return seen.select(*KEYS, F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), F.round("period", 5).alias("period"))


def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of each recording after every 500 arrivals, as a stream of the events gives them."""
    e = table(spark, d, "events")
    raw = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (us - F.unix_micros(F.date_trunc("month", "ts").cast("timestamp"))) / F.lit(1e6)
    rows = raw.select(F.date_format("ts", "yyyy-MM").alias("mission_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), us.alias("us"), t.alias("t"))
    out = fresh_folder(spark)
    q = monitor.snapshots_of(rows, 500, C).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(monitor.SNAPSHOT).parquet(f"{out}/rows")


def recording_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Generated recordings in three formats, parsed on the executors: messages, topics and time by format."""
    import pyarrow as pa

    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = recordings.synthetic({"/imu/data": 100.0, "/odom": 50.0, "/scan": 10.0}, 10.0, seed=k)
                for kind, data in (("mcap", recordings.write_mcap(rows, 200)), ("db3", recordings.write_db3(rows)), ("ulg", recordings.write_ulg(rows))):
                    seen = list(recordings.READERS[kind](data))
                    yield pa.RecordBatch.from_pydict({"seed": [k], "kind": [kind], "messages": [len(seen)], "same": [[(t, x // 1000) for t, x, _, _ in seen] == [(t, x // 1000) for t, x, _, _ in rows]]})

    return spark.range(4).mapInArrow(run, "seed long, kind string, messages long, same boolean")


def db3_join(spark: SparkSession, d: str) -> DataFrame:
    """Topics with or without messages: count and first and last time."""
    topics = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("topic_id"), F.col("n_name").alias("name"))
    messages = table(spark, d, "events").select((F.col("user_id") % 30).alias("topic_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return topics.join(messages, "topic_id", "left").groupBy("name").agg(F.count("us").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def keyframes_nearest(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.range(12).select((F.col("id") * 36000.0).alias("target"))
    return frames.nearest_frames(arrivals(spark, d), targets, list(KEYS), 3600.0).select(*KEYS, "target", "seq", F.round("off_s", 6).alias("off_s"))


def pointcloud_summary(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d).select(*KEYS, "us", "seq", F.col("k").alias("points"), (F.col("k") * 12).alias("bytes"))
    out = frames.cloud_summary(a, list(KEYS), None)
    return out.select(*KEYS, "n", F.round("mean_points", 4).alias("mean_points"), "min_points", "max_points", F.round("empty_share", 4).alias("empty_share"), F.round("mean_bytes", 4).alias("mean_bytes"), "verdict")


QUERIES = {f.__name__: f for f in (stream_gaps, stream_snapshots, recording_roundtrip, db3_join, keyframes_nearest, pointcloud_summary)}

SQL = {
    "stream_gaps": chain(f"SELECT {K}, round(first_value((us - m) / 1e6 - dt) OVER w, 6) AS t_start, round((us - m) / 1e6, 6) AS t_end, round(first_value(period) OVER w, 5) AS period FROM (SELECT *, epoch_us(strptime(mission_id || '-01', '%Y-%m-%d')) AS m FROM c2) WINDOW w AS (PARTITION BY {K}, gap ORDER BY us, seq)", "c2"),
    "db3_join": "SELECT n_name AS name, count(us) AS n, min(us) AS first_us, max(us) AS last_us FROM nation LEFT JOIN (SELECT user_id % 30 AS topic_id, epoch_us(ts) AS us FROM events) ON topic_id = n_nationkey GROUP BY n_name",
    "keyframes_nearest": chain(f"SELECT {K}, target, seq, round(off, 6) AS off_s FROM (SELECT {K}, i * 36000.0::DOUBLE AS target, seq, abs(t - i * 36000.0::DOUBLE) AS off, row_number() OVER (PARTITION BY {K}, i ORDER BY abs(t - i * 36000.0::DOUBLE), us, seq) AS q FROM a, range(12) r(i) WHERE abs(t - i * 36000.0::DOUBLE) <= 3600.0) WHERE q = 1", "a"),
    "pointcloud_summary": chain(f"SELECT {K}, n, round(m, 4) AS mean_points, lo AS min_points, hi AS max_points, round(e, 4) AS empty_share, round(b, 4) AS mean_bytes, CASE WHEN e > 0.1 THEN 'empty_clouds' WHEN lo < 0.5 * m THEN 'uneven' ELSE 'steady' END AS verdict FROM (SELECT {K}, count(*) AS n, avg(k) AS m, min(k) AS lo, max(k) AS hi, avg((k = 0)::INT::DOUBLE) AS e, avg(k * 12) AS b FROM a GROUP BY ALL)", "a"),
}
