"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import analyse, detect, fleet, live
from tidemark.sources.events import arrivals

SF = "/root/testdata/sf0.001"
SQL = detect.SQL | analyse.SQL | fleet.SQL
QUERIES = detect.QUERIES | analyse.QUERIES | fleet.QUERIES
#: A few of each kind; the others run through the driver's comparison.
SOME = ["arrival_interarrival", "cadence_warmup_period", "gap_merged", "jitter_rolling_cv", "topic_score", "overall_verdict", "rate_degradation", "dropped_estimate", "audit_findings", "related_findings", "event_timeline_union", "log_filter_levels", "ewma_interarrival", "concurrency_classify", "describe_field", "outliers_mad", "ks_statistic", "theil_sen_trend", "log_template_cluster", "trajectory_summary", "stall_attribution", "cohort_compare", "preflight", "gate_decisions", "quality_gate", "qos_rules", "mission_similarity", "nation_orders"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    frame = frame.where(frame.notna(), None)
    return cols, sorted(tuple(None if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r).__repr__() for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(SQL[name]).df())
    spark.catalog.clearCache()


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == {"dtw_rank", "caveats", "find_similar"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_timeline_has_all_errors(spark):
    a = arrivals(spark, SF).select("mission_id", "topic", "t", "v").toPandas()
    g = a.groupby(["mission_id", "topic"]).v
    hot = a[((a.v - g.transform("mean")) / g.transform("std")).abs() > 2.5]
    want = [("outlier", m, k, round(t, 6), 3) for m, k, t in zip(hot.mission_id, hot.topic, hot.t, strict=True)]
    err = a[a.topic == "error"]
    want += [("error", m, k, round(t, 6), 2) for m, k, t in zip(err.mission_id, err.topic, err.t, strict=True)]
    want.sort(key=lambda x: (x[3], x[0], x[2], x[1]))
    got = [tuple(r) for r in QUERIES["event_timeline_union"](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want[:200])) and len(got) == 200


def test_clouds_of_whole_topics(spark):
    a = arrivals(spark, SF).select("mission_id", "topic", "k").toPandas()
    want = {k: (len(g), g.k.min(), g.k.max(), round(g.k.mean(), 4)) for k, g in a.groupby(["mission_id", "topic"])}
    got = {(r.mission_id, r.topic): (r.n, r.min_points, r.max_points, r.mean_points) for r in live.QUERIES["pointcloud_summary"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want) and max(w[0] for w in want.values()) > 200


def test_log_filter_reads_whole_texts(spark, tmp_path):
    rows = [(1, 1, "user", "x" * 80 + " then"), (1, 2, "user", "nothing"), (2, 1, "user", "then"), (15, 1, "assistant", "that " + "y" * 90), (15, 2, "assistant", "z" * 60 + "THE")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.level: r.n for r in QUERIES["log_filter_levels"](spark, str(tmp_path)).collect()}
    assert got == {"user": 1, "assistant": 2}
