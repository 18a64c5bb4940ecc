"""Stalls over time, also of recordings that have none."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.operators.attribution import dispersion
from tidemark.plans import analyse

DAY = 86_400_000_000


def test_dispersion_of_a_mission_without_stalls(spark):
    stalls = spark.createDataFrame([("a", 5.0), ("a", 35.0), ("a", 36.0), ("a", 95.0)], "mission_id string, t_start double")
    ends = spark.createDataFrame([("a", 119.0), ("b", 119.0), ("c", 0.0)], "mission_id string, t_end double")
    got = {r.mission_id: r for r in dispersion(stalls, ends).collect()}
    assert (got["a"].n, got["a"]["index"], got["a"].pattern) == (4, 0.5, "random")
    assert all((got[m].n, math.isnan(got[m]["index"]), got[m].pattern) == (0, True, "unknown") for m in "bc")


def test_dispersion_without_stalls_equals_sql(spark, tmp_path):
    n = 400
    ts = [1_704_067_200_000_000 + i * 2 * DAY // n for i in range(n)]
    pq.write_table(pa.table({"event_id": list(range(n)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1] * n, "event_type": ["ab"[i % 2] for i in range(n)], "value": [1.0] * n, "props": ['{"k": 1}'] * n}), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    (want,) = con.sql("SELECT mission_id, n, index, pattern FROM (" + analyse.SQL["stall_pattern_dispersion"] + ")").fetchall()
    (got,) = analyse.QUERIES["stall_pattern_dispersion"](spark, str(tmp_path)).select("mission_id", "n", "index", "pattern").collect()
    assert str(tuple(got)) == str(want) == "('2024-01', 0, nan, 'unknown')"
