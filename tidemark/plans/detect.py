"""Queries of the detectors over the events table, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EVENTS as C
from tidemark.operators import cadence, clock, degradation, findings, gaps, health
from tidemark.operators.intervals import merged
from tidemark.sources.events import KEYS, arrivals
from tidemark.sources.tables import kept

R6 = lambda c: F.round(c, 6)


def _ia(spark, d):
    return cadence.interarrival(arrivals(spark, d))


def _pos(spark, d):
    return cadence.positive(_ia(spark, d), C)


def _timed(spark, d):
    return cadence.timed(arrivals(spark, d), C)[0]


def _found(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with periods, the periods, and gaps: the last two are a few rows for each topic, used several times and kept."""
    timed, periods = cadence.timed(a, C)
    return timed, periods, kept(gaps.gaps(gaps.candidates(timed, C), C))


def _gaps(spark, d):
    return gaps.gaps(gaps.candidates(_timed(spark, d), C), C)


def _ends(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mission_id").agg(F.max("t").alias("t_end"))


def _topics(rates: DataFrame, periods: DataFrame) -> DataFrame:
    r = rates.join(periods, list(KEYS), "left")
    return r.select(*KEYS, "first_t", F.coalesce("period", "mean_dt").alias("nominal"), (health.status(F.col("period"), F.col("sustained_hz"), C) == "assessed").alias("assessable"))


def _classed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Gaps with their class, and the ends of recordings."""
    a = arrivals(spark, d)
    _, periods, found = _found(a)
    return kept(health.concurrency(found, _topics(cadence.rates(a), periods), a, C)), _ends(a)


def _stalls(spark, d) -> DataFrame:
    return health.stalls(*_classed(spark, d), C)


def arrival_interarrival(spark: SparkSession, d: str) -> DataFrame:
    return _ia(spark, d).select(*KEYS, "seq", "n", R6("t").alias("t"), R6("dt").alias("dt"))


def arrival_rates(spark: SparkSession, d: str) -> DataFrame:
    r = cadence.rates(arrivals(spark, d))
    return r.select(*KEYS, "n", *[R6(c).alias(c) for c in ("first_t", "last_t", "sustained_hz", "mean_dt")])


def late_or_duplicate_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals that come no later than the one with the number before, or at the same time."""
    from pyspark.sql import Window

    a = arrivals(spark, d)
    w = Window.partitionBy(*KEYS).orderBy("seq")
    a = a.withColumn("prev", F.lag("us").over(w))
    return a.groupBy(*KEYS).agg(F.sum((F.col("us") < F.col("prev")).cast("long")).alias("late"), F.sum((F.col("us") == F.col("prev")).cast("long")).alias("repeated")).fillna(0)


def cadence_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cadence.histogram(_ia(spark, d), C)


def cadence_mode(spark: SparkSession, d: str) -> DataFrame:
    return cadence.mode(_ia(spark, d), C).select(*KEYS, "bin", "n", R6("mode_s").alias("mode_s"))


def cadence_running_mode(spark: SparkSession, d: str) -> DataFrame:
    return _pos(spark, d).select(*KEYS, "seq", "pr", "mode_bin")


def cadence_warmup_period(spark: SparkSession, d: str) -> DataFrame:
    return cadence.timed(arrivals(spark, d), C)[1].select(*KEYS, "warm_n", R6("period").alias("period"), R6("period_cv").alias("period_cv"))


def cadence_aperiodic(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    r = cadence.rates(a).join(cadence.timed(a, C)[1], list(KEYS), "left")
    return r.select(*KEYS, health.status(F.col("period"), F.col("sustained_hz"), C).alias("status"))


def qos_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Periods of topics that promise one: 600 s for those of five letters and fewer, else 60 s."""
    a = arrivals(spark, d)
    declared = a.select(*KEYS).distinct().withColumn("declared_s", F.when(F.length("topic") <= 5, 600.0).otherwise(60.0))
    out = cadence.timed(a, C, declared)[1]
    return out.select(*KEYS, R6("observed").alias("observed"), "declared_s", R6("period").alias("period"), "mismatch")


def gap_detect(spark: SparkSession, d: str) -> DataFrame:
    return gaps.candidates(_timed(spark, d), C).select(*KEYS, "seq", R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), R6("period").alias("period"))


def gap_merged(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select(*KEYS, R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), "pieces", R6("silent_s").alias("silent_s"), "severity", "lost", F.round("confidence", 4).alias("confidence"))


def gap_severity(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy(*KEYS, "severity").agg(F.count("*").alias("n"))


def gap_topn_bounded(spark: SparkSession, d: str) -> DataFrame:
    return gaps.longest(_gaps(spark, d), 5).select(*KEYS, "rank", R6("t_start").alias("t_start"), R6("duration_s").alias("duration_s"), "evicted")


def gap_totals(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n_gaps"), F.sum("silent_s").alias("silent_s"), F.sum("lost").alias("lost"))
    return g.select(*KEYS, "n_gaps", F.round("silent_s", 4).alias("silent_s"), "lost")


def jitter_rolling_cv(spark: SparkSession, d: str) -> DataFrame:
    return gaps.jitter_cv(_timed(spark, d), C).select(*KEYS, "seq", "win_n", R6("cv").alias("cv"))


def jitter_episodes(spark: SparkSession, d: str) -> DataFrame:
    out = gaps.jitter_episodes(gaps.jitter_cv(_timed(spark, d), C), C)
    return out.select(*KEYS, R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), F.round("peak", 4).alias("peak"), F.round("threshold", 4).alias("threshold"), "severity")


def dropped_estimate(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    _, periods, found = _found(a)
    rates, ends = cadence.rates(a), _ends(a)
    lost = health.stalled_seconds(found, health.stalls(health.concurrency(found, _topics(rates, periods), a, C), ends, C))
    out = gaps.dropped(rates, periods, found, ends, lost)
    return out.select(*KEYS, "count_based", F.col("gap_based").cast("long").alias("gap_based"), F.col("dropped").cast("long").alias("dropped"), F.round("rate", 4).alias("rate"), F.round("agreement", 4).alias("agreement"), "severity")


def _clocked(spark, d):
    a = arrivals(spark, d)
    return clock.with_clock(a.withColumn("pub_us", F.col("us") - (F.col("seq") % 97) * 1000))


def clock_backward(spark: SparkSession, d: str) -> DataFrame:
    return clock.backward(_clocked(spark, d)).select(*KEYS, "jumps", R6("largest").alias("largest"))


def clock_divergence(spark: SparkSession, d: str) -> DataFrame:
    return clock.steps(_clocked(spark, d), C.step).select(*KEYS, "seq", R6("t").alias("t"), "divergence", "direction")


def recorder_lag_summary(spark: SparkSession, d: str) -> DataFrame:
    return clock.lag(_clocked(spark, d)).select("mission_id", *[R6(c).alias(c) for c in ("mean_lag", "peak_lag", "first_lag", "last_lag")])


def lag_curve_decimated(spark: SparkSession, d: str) -> DataFrame:
    rows = clock.decimated(_clocked(spark, d), list(KEYS), ["us", "seq"], 20)
    return rows.select(*KEYS, "position", R6("t").alias("t"), R6((F.col("us") - F.col("pub_us")) / 1e6).alias("lag"))


def concurrency_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d)[0].select(*KEYS, R6("t_start").alias("t_start"), "eligible", "co_silent", "co_topics", R6("concurrency").alias("concurrency"), "class")


def merged_stalls(spark: SparkSession, d: str) -> DataFrame:
    return _stalls(spark, d).select("mission_id", R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), "pieces", F.array_join("topics", ",").alias("topics"))


def gap_stall_rollup(spark: SparkSession, d: str) -> DataFrame:
    classed, ends = _classed(spark, d)
    out = health.rolled_up(classed, health.stalls(classed, ends, C))
    return out.groupBy(*KEYS).agg(F.count("*").alias("n_gaps"), F.count("stall").alias("absorbed"))


def gap_stall_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each topic's gaps within stalls."""
    classed, ends = _classed(spark, d)
    return health.stalled_seconds(classed, health.stalls(classed, ends, C)).select(*KEYS, F.round("stall_s", 4).alias("stall_s"))


def rate_buckets(spark: SparkSession, d: str) -> DataFrame:
    return degradation.rate_buckets(_timed(spark, d), C).select(*KEYS, "k", R6("x").alias("x"), F.round(F.col("hz") * 1000, 6).alias("mhz"))


def rate_degradation(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    out = degradation.degradation(cadence.timed(a, C)[0], _ends(a), C)
    return out.select(*KEYS, R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), F.round("slope", 4).alias("slope"), "severity", F.round(F.col("hz_start") * 1000, 4).alias("mhz_start"), F.round(F.col("hz_end") * 1000, 4).alias("mhz_end"), F.col("episodes").cast("int").alias("episodes"))


def streaming_unassessable(spark: SparkSession, d: str) -> DataFrame:
    """How many arrivals of each topic came while it had no usable rate."""
    return health.unassessable_so_far(_timed(spark, d), C).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.col("blind").cast("long")).alias("blind"))


def gap_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ten silent intervals of each recording with the most silent company, then the longest."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("mission_id").orderBy(F.desc("concurrency"), F.desc("duration_s"), "t_start", "topic"))
    rows = _classed(spark, d)[0].withColumn("concurrency", R6("concurrency")).withColumn("duration_s", R6("duration_s")).withColumn("rank", rank).where("rank <= 10")
    return rows.select("rank", *KEYS, "concurrency", "duration_s")


def gap_nearest_interval(spark: SparkSession, d: str) -> DataFrame:
    """Each gap of a topic with the nearest error arrival in time."""
    a = arrivals(spark, d).where("topic = 'error'").select("mission_id", F.col("t").alias("at"))
    found = _gaps(spark, d).where("topic <> 'error'")
    topics = found.select(*KEYS).distinct()
    out = health.nearest(found, topics.join(a, "mission_id"))
    return out.select(*KEYS, R6("t_start").alias("t_start"), R6("nearest_start").alias("nearest_start"))


def interval_union_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds in which any topic of a recording was silent."""
    m = merged(_gaps(spark, d), ["mission_id"], "t_start", "t_end")
    return m.groupBy("mission_id").agg(F.count("*").alias("pieces"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 4).alias("seconds"))


def density_timeline(spark: SparkSession, d: str) -> DataFrame:
    return health.timeline(arrivals(spark, d), C)


def coverage_fraction(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    return health.coverage(health.timeline(a, C), _ends(a)).select("mission_id", "covered", "columns", R6("coverage").alias("coverage"))


def audited(a: DataFrame, files: DataFrame | None = None, c=C, declared: DataFrame | None = None) -> dict[str, DataFrame]:
    """All detectors over arrivals: periods, gaps (classed), stalls, drifts, jitter, drops, topics and recordings.

    files(mission_id, file_score) has scores of the files they come from, declared(keys, declared_s) the periods that
    topics promise. What is a few rows for each topic is kept.
    """
    a = kept(cadence.warmed(cadence.interarrival(a), c).select(*KEYS, "seq", "us", "t", "dt", "n", "first_t", "warm_n"))
    timed, periods = cadence.timed_of(a, c, declared)
    found = kept(gaps.gaps(gaps.candidates(timed, c), c))
    rates, ends = kept(cadence.rates(a)), kept(_ends(a))
    topics = _topics(rates, periods)
    classed = kept(health.concurrency(found, topics, a, c))
    stalls = kept(health.stalls(classed, ends, c))
    lost = health.stalled_seconds(found, stalls)
    drops = kept(gaps.dropped(rates, periods, found, ends, lost))
    cvs = kept(gaps.jitter_cv(timed, c).select(*KEYS, "seq", "us", "t", "n", "warm_n", "cv", "win_n"))
    drifts = kept(degradation.degradation(timed, ends, c))
    last = cvs.groupBy(*KEYS).agg(F.max_by("cv", "n").alias("cv"))
    drift = drifts.groupBy(*KEYS).agg(F.max(F.abs("slope")).alias("drift"))
    h = kept(health.topic_health(rates, periods, found, drops, ends, last, drift, lost, c))
    columns = health.timeline(a, c).join(h.where("status = 'assessed'").select(*KEYS), list(KEYS), "left_semi")
    verdicts = health.verdict(h, health.coverage(columns, ends), files)
    return {"periods": periods, "gaps": classed, "silences": found, "stalls": stalls, "implausible": health.implausible(classed, ends, c), "drifts": drifts, "jitter": gaps.jitter_episodes(cvs, c), "drops": drops, "topics": h, "recordings": verdicts, "ends": ends}


def _files(a: DataFrame) -> DataFrame:
    """Scores of files for recordings that have none: an arrival with k = 99 stands for one that does not decode."""
    share = F.avg((F.coalesce("k", F.lit(0)) == 99).cast("double"))
    return a.groupBy("mission_id").agg((100.0 - 80.0 * share - F.when(share > 0.01, 6.0).otherwise(0.0)).alias("file_score"))


def topic_score(spark: SparkSession, d: str) -> DataFrame:
    h = audited(arrivals(spark, d))["topics"]
    return h.select(*KEYS, "status", "n", "n_gaps", F.round("silent_s", 4).alias("silent_s"), F.round("stall_s", 4).alias("stall_s"), F.round("cv", 4).alias("cv"), F.round("drift", 4).alias("drift"), F.round("expected_hz", 6).alias("expected_hz"), F.round("observed_hz", 6).alias("observed_hz"), "score")


def overall_verdict(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    out = audited(a, _files(a))["recordings"]
    return out.select("mission_id", "topics", "assessed", "messages", F.round("stalled_s", 4).alias("stalled_s"), "confidence", F.round("file_score", 4).alias("file_score"), F.round("score", 4).alias("score"), "verdict")


def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all detectors, those of gaps that a stall explains folded into it."""
    out = findings.findings(audited(arrivals(spark, d)), C)
    return out.select("detector", "severity", "mission_id", "topic", R6("t_start").alias("t_start"), R6("t_end").alias("t_end"), F.round("value", 4).alias("value"), "rolled_up")


def related_findings(spark: SparkSession, d: str) -> DataFrame:
    """How many findings overlap each stall in time, ten of them at most listed by the caller."""
    f = kept(findings.findings(audited(arrivals(spark, d)), C))
    out = findings.related(f.where("detector = 'stall'"), f)
    return out.select("mission_id", R6("t_start").alias("t_start"), "related", F.array_join("kinds", ",").alias("kinds"))


def caveats(spark: SparkSession, d: str) -> DataFrame:
    """What must not be concluded from each recording."""
    found = audited(arrivals(spark, d))
    return findings.caveats(found, kept(findings.findings(found, C))).select("mission_id", "place", "caveat")


QUERIES = {f.__name__: f for f in (arrival_interarrival, arrival_rates, late_or_duplicate_arrivals, cadence_log_histogram, cadence_mode, cadence_running_mode, cadence_warmup_period, cadence_aperiodic, qos_mismatch, gap_detect, gap_merged, gap_severity, gap_topn_bounded, gap_totals, jitter_rolling_cv, jitter_episodes, dropped_estimate, clock_backward, clock_divergence, recorder_lag_summary, lag_curve_decimated, concurrency_classify, merged_stalls, gap_stall_rollup, gap_stall_seconds, rate_buckets, rate_degradation, streaming_unassessable, gap_ranking, gap_nearest_interval, interval_union_seconds, density_timeline, coverage_fraction, topic_score, overall_verdict, audit_findings, related_findings, caveats)}

_LN = f"{math.log(C.lo)!r}::DOUBLE"
_SCALE = f"{C.bins / (math.log(C.hi) - math.log(C.lo))!r}::DOUBLE"


def _bin(dt: str) -> str:
    return f"least(floor((ln(least(greatest({dt}, {C.lo}::DOUBLE), {C.hi}::DOUBLE)) - {_LN}) * {_SCALE}), {C.bins - 1})::INT"


def _centre(b: str) -> str:
    return f"exp({_LN} + ({b} + 0.5::DOUBLE) / {_SCALE})"


K = "mission_id, topic"
#: Steps of the chain, by name; each may use the ones before.
STEPS = {
    "ev": "SELECT strftime(ts, '%Y-%m') AS mission_id, event_type AS topic, event_id AS seq, epoch_us(ts) AS us, value AS v, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "a": "SELECT *, (us - min(us) OVER (PARTITION BY mission_id)) / 1e6 AS t FROM ev",
    "ia": f"SELECT *, t - lag(t) OVER w AS dt, row_number() OVER w AS n, first_value(t) OVER w AS first_t FROM a WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "p0": f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY us, seq) AS pr, {_bin('dt')} AS bin FROM ia WHERE dt > 0",
    "p1": f"SELECT *, count(*) OVER (PARTITION BY {K}, bin ORDER BY us, seq) AS c FROM p0",
    "p2": f"SELECT *, max(c) OVER (PARTITION BY {K} ORDER BY us, seq) AS m FROM p1",
    "p3": f"SELECT *, min(CASE WHEN c = m THEN bin END) OVER (PARTITION BY {K}, m ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS mode_bin, quantile_cont(dt, 0.5) OVER (PARTITION BY {K} ORDER BY us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run_median FROM p2",
    "pos": f"SELECT *, {_centre('mode_bin')} AS run_mode FROM p3",
    "warm": f"SELECT {K}, min(n) AS warm_n FROM pos WHERE n >= {C.warm_messages} AND t - first_t >= {C.warm_seconds} GROUP BY ALL",
    "ring": f"SELECT * FROM (SELECT pos.*, warm_n, row_number() OVER (PARTITION BY pos.mission_id, pos.topic ORDER BY pr DESC) AS r FROM pos JOIN warm USING ({K}) WHERE n <= warm_n) WHERE r <= {C.ring}",
    "md": f"SELECT {K}, warm_n, arg_max(run_mode, pr) AS mode_s FROM ring GROUP BY ALL",
    "wide": f"SELECT {K}, md.warm_n, max(mode_s) AS mode_s, coalesce(quantile_cont(dt, 0.5) FILTER (dt > 0.5 * mode_s AND dt < 1.5 * mode_s), max(mode_s)) AS o1 FROM ring JOIN md USING ({K}) GROUP BY ALL",
    "learned": f"SELECT {K}, wide.warm_n, coalesce(quantile_cont(dt, 0.5) FILTER (abs(dt - o1) < {C.refine} * o1 AND dt > 0.5 * mode_s AND dt < 1.5 * mode_s), max(o1)) AS period, CASE WHEN count(*) FILTER (abs(dt - o1) < {C.refine} * o1 AND dt > 0.5 * mode_s AND dt < 1.5 * mode_s) > 2 THEN stddev_samp(dt) FILTER (abs(dt - o1) < {C.refine} * o1 AND dt > 0.5 * mode_s AND dt < 1.5 * mode_s) / avg(dt) FILTER (abs(dt - o1) < {C.refine} * o1 AND dt > 0.5 * mode_s AND dt < 1.5 * mode_s) ELSE 0.02 END AS period_cv FROM ring JOIN wide USING ({K}) GROUP BY ALL",
    "timed": f"SELECT pos.*, l.warm_n, CASE WHEN n >= l.warm_n THEN l.period WHEN pr >= 5 THEN run_mode ELSE run_median END AS period FROM pos LEFT JOIN learned l USING ({K})",
    "cand": f"SELECT {K}, seq, us, t - dt AS t_start, t AS t_end, dt, period FROM timed WHERE dt > greatest({C.gap_k} * period, {C.gap_floor})",
    "c1": f"SELECT *, CASE WHEN coalesce(t_start - lag(t_end) OVER (PARTITION BY {K} ORDER BY us, seq) > {C.merge_periods} * period, true) THEN 1 ELSE 0 END AS fresh FROM cand",
    "c2": f"SELECT *, sum(fresh) OVER (PARTITION BY {K} ORDER BY us, seq) AS gap FROM c1",
    "g0": f"SELECT {K}, gap, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS pieces, sum(dt) AS silent_s, arg_min(period, us) AS period FROM c2 GROUP BY ALL",
    "g1": "SELECT *, t_end - t_start AS duration_s, (t_end - t_start) / period AS periods FROM g0",
    "gaps": f"SELECT *, CASE WHEN duration_s >= 30 OR periods >= 1000 THEN 4 WHEN periods >= 100 THEN 3 WHEN periods >= 20 THEN 2 ELSE 1 END AS severity, greatest(0, round_even(periods, 0)::BIGINT - 1) AS lost, least(1.0, 0.5 + periods / {4 * C.gap_k}) AS confidence FROM g1",
    "rates": f"SELECT {K}, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(*) / nullif(max(t) - min(t), 0) AS sustained_hz, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS mean_dt FROM ia GROUP BY ALL",
    "ends": "SELECT mission_id, max(t) AS t_end FROM ia GROUP BY ALL",
    "cvs": f"SELECT *, count(dt) OVER w AS win_n, CASE WHEN avg(dt) OVER w > 0 THEN coalesce(stddev_samp(dt) OVER w, 0) / avg(dt) OVER w ELSE 0 END AS cv FROM timed WHERE period IS NULL OR dt <= 5 * period WINDOW w AS (PARTITION BY {K} ORDER BY us, seq ROWS BETWEEN {C.jitter_window - 1} PRECEDING AND CURRENT ROW)",
    "base": f"SELECT {K}, arg_min(cv, n) AS baseline FROM cvs WHERE n >= warm_n AND win_n >= 10 GROUP BY ALL",
    "j1": f"SELECT cvs.*, greatest({C.jitter_mult} * baseline, {C.jitter_floor}) AS threshold FROM cvs JOIN base USING ({K}) WHERE win_n >= {C.jitter_least} AND n >= warm_n",
    "j2": f"SELECT *, (cv > threshold)::INT AS high, coalesce(lead(t) OVER (PARTITION BY {K} ORDER BY us, seq), t) AS next_t FROM j1",
    "j3": f"SELECT *, CASE WHEN high <> lag(high, 1, 0) OVER (PARTITION BY {K} ORDER BY us, seq) THEN 1 ELSE 0 END AS flip FROM j2",
    "j4": f"SELECT *, sum(flip) OVER (PARTITION BY {K} ORDER BY us, seq) AS run FROM j3",
    "episodes": f"SELECT {K}, run, min(t) AS t_start, max(next_t) AS t_end, max(cv) AS peak, min(threshold) AS threshold FROM j4 WHERE high = 1 GROUP BY ALL HAVING max(next_t) - min(t) >= {C.jitter_sustain}",
    "topics": f"SELECT {K}, first_t, coalesce(period, mean_dt) AS nominal, period IS NOT NULL AND coalesce(NOT 1 / period > {C.aperiodic_ratio} * sustained_hz, true) AS ok FROM rates LEFT JOIN learned USING ({K})",
    "vg": f"SELECT gaps.* FROM gaps JOIN topics USING ({K}) WHERE ok",
    "shared": f"SELECT g.mission_id, g.topic, g.gap, o.topic AS other, sum(greatest(0, least(g.t_end, o.t_end) - greatest(g.t_start, o.t_start))) AS s FROM vg g JOIN vg o ON g.mission_id = o.mission_id AND g.topic <> o.topic AND g.t_start < o.t_end AND o.t_start < g.t_end AND o.t_end <= g.t_end GROUP BY ALL",
    "asked": "SELECT g.mission_id, g.topic, g.gap, g.t_start AS ls, g.t_end AS le, p.topic AS other, coalesce(p.ok AND p.nominal > 0 AND p.nominal < g.t_end - g.t_start, false) AS due FROM vg g JOIN topics p ON g.mission_id = p.mission_id AND g.topic <> p.topic AND p.first_t <= g.t_start",
    "seen": "SELECT asked.*, a.t AS last_seen FROM asked ASOF LEFT JOIN a ON asked.mission_id = a.mission_id AND asked.other = a.topic AND asked.le >= a.t",
    "silent": f"SELECT seen.*, due AND (coalesce(s, 0) >= {C.overlap} * (le - ls) OR last_seen <= ls) AS hit FROM seen LEFT JOIN shared USING (mission_id, topic, gap, other)",
    "votes": "SELECT mission_id, topic, gap, count(*) AS there, sum(due::INT)::BIGINT AS eligible, sum(hit::INT)::BIGINT AS co_silent, coalesce(string_agg(other, ',' ORDER BY other) FILTER (hit), '') AS co_topics FROM silent GROUP BY ALL",
    "expected": "SELECT mission_id, count(*) AS expected FROM rates GROUP BY ALL",
    "classed": f"SELECT *, CASE WHEN concurrency > {C.system_wide} THEN 'system_wide' WHEN concurrency < {C.isolated} THEN 'isolated' ELSE 'subsystem' END AS class FROM (SELECT vg.*, coalesce(eligible, 0) AS eligible, coalesce(co_silent, 0) AS co_silent, coalesce(co_topics, '') AS co_topics, CASE WHEN coalesce(eligible, 0) > 0 THEN co_silent / greatest(eligible::DOUBLE, (expected - 1) * eligible / there) ELSE 0 END AS concurrency FROM vg LEFT JOIN votes USING (mission_id, topic, gap) JOIN expected USING (mission_id))",
    "s1": f"SELECT c.*, e.t_end AS rec_end, h FROM classed c JOIN (SELECT mission_id, max(t_end) - min(t_start) AS h FROM classed GROUP BY ALL) USING (mission_id) JOIN ends e USING (mission_id) WHERE class = 'system_wide' AND c.t_end - t_start <= {C.stall_fraction} * greatest(h, e.t_end)",
    "s2": f"SELECT *, CASE WHEN coalesce(t_start - max(t_end) OVER (PARTITION BY mission_id ORDER BY t_start, t_end, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {C.stall_slack}, true) THEN 1 ELSE 0 END AS fresh FROM s1",
    "s3": "SELECT *, sum(fresh) OVER (PARTITION BY mission_id ORDER BY t_start, t_end, topic) AS stall FROM s2",
    "stalls": "SELECT mission_id, stall, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS pieces, first(concurrency ORDER BY t_start, t_end, topic) AS concurrency, array_to_string(list_sort(list_distinct(list_filter(flatten(list(list_append(string_split(co_topics, ','), topic))), lambda x: x <> ''))), ',') AS topics FROM s3 GROUP BY ALL",
    "stalled": f"SELECT g.mission_id, g.topic, sum(least(g.t_end, s.t_end) - greatest(g.t_start, s.t_start)) AS stall_s FROM gaps g JOIN stalls s ON g.mission_id = s.mission_id AND g.t_start < s.t_end AND s.t_start < g.t_end GROUP BY ALL",
    "bygap": f"SELECT {K}, sum(CASE WHEN severity = 4 THEN duration_s ELSE 0 END) AS critical, sum(CASE WHEN severity < 4 THEN greatest(0, round_even(duration_s / l.period, 0)::BIGINT - 1) ELSE 0 END) AS by_gaps FROM gaps JOIN learned l USING ({K}) GROUP BY ALL",
    "d1": f"SELECT {K}, n, period_cv, greatest(0, coalesce(by_gaps, 0) - round_even(coalesce(stall_s, 0) / period, 0))::BIGINT AS gap_based, (1 / period) * greatest(1e-9, t_end - first_t - greatest(coalesce(critical, 0), coalesce(stall_s, 0))) AS expected_n FROM rates JOIN learned USING ({K}) LEFT JOIN bygap USING ({K}) LEFT JOIN stalled USING ({K}) JOIN ends USING (mission_id)",
    "d2": "SELECT *, greatest(0, round_even(expected_n, 0)::BIGINT - n) AS count_based FROM d1",
    "d3": "SELECT *, greatest(count_based, gap_based) AS most, CASE WHEN expected_n > 0 THEN greatest(count_based, gap_based) / expected_n ELSE 0 END AS rate FROM d2",
    "d4": f"SELECT {K}, n, count_based, gap_based, CASE WHEN rate < greatest(0.02, 4 * period_cv / sqrt(50.0)) OR most < 5 OR n < 2 THEN 0 ELSE most END AS dropped, rate, 1 - abs(count_based - gap_based) / greatest(most, 1) AS agreement FROM d3",
    "drops": "SELECT *, CASE WHEN dropped > 0 THEN CASE WHEN rate >= 0.30 THEN 4 WHEN rate >= 0.10 THEN 3 WHEN rate >= 0.03 THEN 2 ELSE 1 END ELSE 0 END AS severity FROM d4",
    "el": f"SELECT *, row_number() OVER w AS i, first_value(t) OVER w AS t0 FROM timed WHERE period IS NULL OR dt <= 5 * period WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "el2": f"SELECT *, lag(b, 1, 0) OVER (PARTITION BY {K} ORDER BY us, seq) AS pb FROM (SELECT {K}, us, seq, t0, i, period, floor((t - t0) / {C.bucket})::BIGINT AS b FROM el)",
    "dts": f"SELECT {K}, list(dt ORDER BY us, seq) AS l FROM el GROUP BY ALL",
    "bk": f"SELECT {K}, k, t0 + (k + 0.5::DOUBLE) * {C.bucket} AS x, 1 / ew AS hz, 1 / period AS base FROM (SELECT {K}, t0, period, unnest(range(pb, b)) AS k, list_reduce(list_slice(l, 1, i), lambda acc, x: acc + {C.ewma}::DOUBLE * (x - acc)) AS ew FROM el2 JOIN dts USING ({K}) WHERE b > pb)",
    "pairs": f"SELECT e.mission_id, e.topic, e.k, e.base, (j.hz - i.hz) / ((j.k - i.k) * {C.bucket}) AS g, sign(j.hz - i.hz) AS sg FROM bk e JOIN bk i ON i.mission_id = e.mission_id AND i.topic = e.topic AND i.k > e.k - {C.bucket_keep} AND i.k < e.k JOIN bk j ON j.mission_id = e.mission_id AND j.topic = e.topic AND j.k > i.k AND j.k <= e.k WHERE e.k >= {C.bucket_least - 1}",
    "trd": f"SELECT mission_id, topic, k, quantile_cont(g, 0.5) * (least(k + 1, {C.bucket_keep}) - 1) * {C.bucket} / any_value(base) AS rel, abs(sum(sg) / greatest(sum(abs(sg)), 1)) AS tau, least(k + 1, {C.bucket_keep}) AS m FROM pairs GROUP BY mission_id, topic, k",
    "fi": f"SELECT *, k - row_number() OVER (PARTITION BY {K} ORDER BY k) AS grp FROM trd WHERE abs(rel) > {C.drift} AND tau / sqrt(2.0::DOUBLE * (2 * m + 5) / (9.0::DOUBLE * m * (m - 1))) > 1.959963984540054::DOUBLE",
    "e1": f"SELECT {K}, min(k) AS k0, max(k) AS k1, arg_max(rel, abs(rel)) AS rel FROM fi GROUP BY mission_id, topic, grp",
    "e2": f"SELECT e.mission_id, e.topic, e.k0, e.rel, s.x AS t_start, s.hz AS hz0, coalesce(z.x, ends.t_end) AS t_end, coalesce(z.hz, l.hz) AS hz1, CASE WHEN abs(e.rel) >= 0.4 THEN 3 WHEN abs(e.rel) >= 0.2 THEN 2 ELSE 1 END AS sev FROM e1 e JOIN bk s ON s.mission_id = e.mission_id AND s.topic = e.topic AND s.k = greatest(0, e.k0 - {C.bucket_keep - 1}) JOIN bk l ON l.mission_id = e.mission_id AND l.topic = e.topic AND l.k = e.k1 LEFT JOIN bk z ON z.mission_id = e.mission_id AND z.topic = e.topic AND z.k = e.k1 + 1 JOIN ends ON ends.mission_id = e.mission_id",
    "e3": f"SELECT *, CASE WHEN coalesce(t_start > max(t_end) OVER (PARTITION BY {K} ORDER BY k0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM e2",
    "e4": f"SELECT *, sum(fresh) OVER (PARTITION BY {K} ORDER BY k0) AS isl FROM e3",
    "drifts": f"SELECT {K}, min(t_start) AS t_start, max(t_end) AS t_end, first(rel ORDER BY k0) AS slope, max(sev) AS severity, first(hz0 ORDER BY k0) AS hz_start, last(hz1 ORDER BY k0) AS hz_end, count(*)::INT AS episodes FROM e4 GROUP BY mission_id, topic, isl",
    "lastcv": f"SELECT {K}, arg_max(cv, n) AS cv FROM cvs GROUP BY ALL",
    "drift": f"SELECT {K}, max(abs(slope)) AS drift FROM drifts GROUP BY ALL",
    "clk": f"SELECT *, (us - lag(us) OVER w) / 1e6 AS d_log, (pub_us - lag(pub_us) OVER w) / 1e6 AS d_pub FROM (SELECT *, us - (seq % 97) * 1000 AS pub_us FROM a) WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "width": f"SELECT mission_id, CASE WHEN floor(e / w) < {C.columns} THEN w ELSE 2 * w END AS width_s FROM (SELECT mission_id, e, {C.column_s} * pow(2.0, greatest(0, ceil(log2((e + 1e-9) / {C.column_s * C.columns})))) AS w FROM (SELECT mission_id, max(t) AS e FROM a GROUP BY ALL))",
    "tl": "SELECT mission_id, topic, width_s, floor(greatest(t, 0) / width_s)::BIGINT AS \"column\", count(*) AS n FROM a JOIN width USING (mission_id) GROUP BY ALL",
    "cov": "SELECT mission_id, covered, floor(t_end / w)::BIGINT + 1 AS columns FROM (SELECT mission_id, count(DISTINCT \"column\") AS covered, max(width_s) AS w FROM tl GROUP BY ALL) JOIN ends USING (mission_id)",
    "sil": f"SELECT {K}, count(*) AS n_gaps, sum(silent_s) AS silent_s FROM gaps GROUP BY ALL",
    "h1": f"SELECT r.mission_id, r.topic, r.n, period, sustained_hz, first_t, t_end, coalesce(n_gaps, 0) AS n_gaps, coalesce(silent_s, 0) AS silent_s, coalesce(stall_s, 0) AS stall_s, coalesce(cv, 0) AS cv, coalesce(drift, 0) AS drift, coalesce(dropped, 0) AS dropped0, 1 / period AS expected_hz FROM rates r LEFT JOIN learned USING ({K}) LEFT JOIN sil USING ({K}) LEFT JOIN stalled USING ({K}) LEFT JOIN lastcv USING ({K}) LEFT JOIN drift USING ({K}) LEFT JOIN (SELECT {K}, dropped FROM drops) d USING ({K}) JOIN ends USING (mission_id)",
    "h2": f"SELECT *, CASE WHEN period IS NULL THEN 'sparse' WHEN expected_hz > {C.aperiodic_ratio} * sustained_hz THEN 'aperiodic' ELSE 'assessed' END AS status, n / greatest(1e-9, t_end - first_t - silent_s) AS observed_hz FROM h1",
    "h3": "SELECT *, CASE WHEN status = 'assessed' THEN dropped0 ELSE 0 END AS dropped FROM h2",
    "health": "SELECT *, CASE WHEN status = 'assessed' THEN round(greatest(0, 100 * (1 - 0.30::DOUBLE * least(1, greatest(0, greatest(0, silent_s - stall_s) / greatest(5, 0.05::DOUBLE * t_end))) - 0.35::DOUBLE * least(1, dropped / greatest(n + dropped, 1)) - 0.20::DOUBLE * least(1, greatest(0, CASE WHEN cv > 0.2 THEN (cv - 0.2::DOUBLE) / 0.8::DOUBLE ELSE 0 END)) - 0.15::DOUBLE * least(1, drift))), 1) ELSE 100 END AS score FROM h3",
    "covok": "SELECT mission_id, count(DISTINCT \"column\") AS covered FROM tl JOIN health USING (mission_id, topic) WHERE status = 'assessed' GROUP BY ALL",
    "file": "SELECT mission_id, 100 - 80 * share - CASE WHEN share > 0.01 THEN 6 ELSE 0 END AS file_score FROM (SELECT mission_id, avg((coalesce(k, 0) = 99)::INT::DOUBLE) AS share FROM a GROUP BY ALL)",
    "inside": "SELECT g.mission_id, g.topic, g.gap, min(s.stall) AS stall FROM gaps g JOIN stalls s ON g.mission_id = s.mission_id AND g.t_start < s.t_end AND s.t_start < g.t_end AND least(g.t_end, s.t_end) - greatest(g.t_start, s.t_start) >= 0.8 * (g.t_end - g.t_start) GROUP BY ALL",
    "okt": f"SELECT {K}, first_t, n FROM health WHERE status = 'assessed'",
    "reject": f"SELECT c.mission_id, count(*) AS rejected FROM classed c JOIN (SELECT mission_id, max(t_end) - min(t_start) AS h FROM classed GROUP BY ALL) USING (mission_id) JOIN ends e USING (mission_id) WHERE class = 'system_wide' AND c.t_end - t_start > {C.stall_fraction} * greatest(h, e.t_end) GROUP BY ALL",
    "fs": f"""SELECT 'gap' AS detector, severity, mission_id, topic, t_start, t_end, periods AS value, 0::BIGINT AS rolled_up FROM gaps JOIN okt USING ({K}) LEFT JOIN inside USING (mission_id, topic, gap) WHERE stall IS NULL
        UNION ALL SELECT 'rate_degradation', severity, mission_id, topic, t_start, t_end, slope, 0 FROM drifts JOIN okt USING ({K})
        UNION ALL SELECT 'jitter', CASE WHEN peak > 3 * threshold THEN 3 ELSE 2 END, mission_id, topic, t_start, t_end, peak, 0 FROM episodes JOIN okt USING ({K})
        UNION ALL SELECT 'dropped', severity, mission_id, topic, first_t, t_end, rate, 0 FROM drops JOIN (SELECT {K}, first_t FROM okt) USING ({K}) JOIN ends USING (mission_id) WHERE dropped > 0
        UNION ALL SELECT 'stall', CASE WHEN t_end - t_start > 5 THEN 4 ELSE 3 END, mission_id, NULL, t_start, t_end, concurrency, coalesce(held, 0) FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t_start, t_end) AS q FROM stalls) LEFT JOIN (SELECT mission_id, stall, count(*) AS held FROM inside JOIN okt USING ({K}) GROUP BY ALL) USING (mission_id, stall) WHERE q <= 50
        UNION ALL SELECT 'subsystem', 3, mission_id, topic, t_start, t_end, concurrency, 0 FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t_start, t_end, topic) AS q FROM classed WHERE class = 'subsystem' AND co_silent >= 2 AND concurrency BETWEEN {C.isolated} AND {C.system_wide}) WHERE q <= 20
        UNION ALL SELECT 'implausible_stalls', 0, mission_id, NULL, 0.0, t_end, rejected, 0 FROM reject JOIN ends USING (mission_id)
        UNION ALL SELECT 'unassessable', 0, mission_id, topic, 0.0, ends.t_end, n, 0 FROM health JOIN ends USING (mission_id) WHERE status <> 'assessed'""",
}


def chain(last: str, until: str) -> str:
    """A statement that ends in last and has the steps up to one of them before it."""
    names = list(STEPS)
    need, todo = set(), {until}
    import re

    while todo:
        name = todo.pop()
        need.add(name)
        todo |= {n for n in names if n not in need and re.search(rf"\b(?:FROM|JOIN) {n}\b", STEPS[name])}
    for n in names:
        if n not in need and re.search(rf"\b(?:FROM|JOIN) {n}\b", last):
            sub, more = set(), {n}
            while more:
                x = more.pop()
                sub.add(x)
                more |= {m for m in names if m not in sub and re.search(rf"\b(?:FROM|JOIN) {m}\b", STEPS[x])}
            need |= sub
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in names if n in need) + "\n" + last


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) AS {x}"


SQL = {
    "arrival_interarrival": chain(f"SELECT {K}, seq, n, {r('t')}, {r('dt')} FROM ia", "ia"),
    "arrival_rates": chain(f"SELECT {K}, n, {r('first_t')}, {r('last_t')}, {r('sustained_hz')}, {r('mean_dt')} FROM rates", "rates"),
    "late_or_duplicate_arrivals": chain(f"SELECT {K}, sum(CASE WHEN us < p THEN 1 ELSE 0 END)::BIGINT AS late, sum(CASE WHEN us = p THEN 1 ELSE 0 END)::BIGINT AS repeated FROM (SELECT *, lag(us) OVER (PARTITION BY {K} ORDER BY seq) AS p FROM a) GROUP BY ALL", "a"),
    "cadence_log_histogram": chain(f"SELECT {K}, bin, count(*) AS n FROM p0 GROUP BY ALL", "p0"),
    "cadence_mode": chain(f"SELECT {K}, bin, n, round({_centre('bin')}, 6) AS mode_s FROM (SELECT {K}, bin, count(*) AS n, row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, bin) AS r FROM p0 GROUP BY mission_id, topic, bin) WHERE r = 1", "p0"),
    "cadence_running_mode": chain(f"SELECT {K}, seq, pr, mode_bin FROM p3", "p3"),
    "cadence_warmup_period": chain(f"SELECT {K}, warm_n, {r('period')}, {r('period_cv')} FROM learned", "learned"),
    "cadence_aperiodic": chain(f"SELECT {K}, CASE WHEN period IS NULL THEN 'sparse' WHEN 1 / period > {C.aperiodic_ratio} * sustained_hz THEN 'aperiodic' ELSE 'assessed' END AS status FROM rates LEFT JOIN learned USING ({K})", "rates"),
    "qos_mismatch": chain(f"SELECT {K}, round(p, 6) AS observed, s AS declared_s, round(CASE WHEN s BETWEEN p / 3 AND p * 3 THEN s ELSE p END, 6) AS period, NOT s BETWEEN p / 3 AND p * 3 AS mismatch FROM (SELECT {K}, period AS p, CASE WHEN length(topic) <= 5 THEN 600.0::DOUBLE ELSE 60.0::DOUBLE END AS s FROM learned)", "learned"),
    "gap_detect": chain(f"SELECT {K}, seq, {r('t_start')}, {r('t_end')}, {r('period')} FROM cand", "cand"),
    "gap_merged": chain(f"SELECT {K}, {r('t_start')}, {r('t_end')}, pieces, {r('silent_s')}, severity, lost, {r('confidence', 4)} FROM gaps", "gaps"),
    "gap_severity": chain(f"SELECT {K}, severity, count(*) AS n FROM gaps GROUP BY ALL", "gaps"),
    "gap_topn_bounded": chain(f"SELECT {K}, rank::INT AS rank, {r('t_start')}, {r('duration_s')}, greatest(0, c - 5) AS evicted FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY duration_s DESC, t_start) AS rank, count(*) OVER (PARTITION BY {K}) AS c FROM gaps) WHERE rank <= 5", "gaps"),
    "gap_totals": chain(f"SELECT {K}, count(*) AS n_gaps, round(sum(silent_s), 4) AS silent_s, sum(lost)::BIGINT AS lost FROM gaps GROUP BY ALL", "gaps"),
    "jitter_rolling_cv": chain(f"SELECT {K}, seq, win_n, {r('cv')} FROM cvs", "cvs"),
    "jitter_episodes": chain(f"SELECT {K}, {r('t_start')}, {r('t_end')}, {r('peak', 4)}, {r('threshold', 4)}, CASE WHEN peak > 3 * threshold THEN 3 ELSE 2 END AS severity FROM episodes", "episodes"),
    "dropped_estimate": chain(f"SELECT {K}, count_based, gap_based, dropped, {r('rate', 4)}, {r('agreement', 4)}, severity FROM drops", "drops"),
    "clock_backward": chain(f"SELECT {K}, coalesce(sum(CASE WHEN d_pub < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS jumps, round(coalesce(max(CASE WHEN d_pub < 0 THEN -d_pub END), 0), 6) AS largest FROM clk GROUP BY ALL", "clk"),
    "clock_divergence": chain(f"SELECT {K}, seq, {r('t')}, round(d_log - d_pub, 6) AS divergence, CASE WHEN d_log - d_pub > 0 THEN 'forward' ELSE 'backward' END AS direction FROM clk WHERE abs(round(d_log - d_pub, 6)) > {C.step}", "clk"),
    "recorder_lag_summary": chain("SELECT mission_id, round(avg(l), 6) AS mean_lag, round(max(abs(l)), 6) AS peak_lag, round(first(l ORDER BY us, seq), 6) AS first_lag, round(last(l ORDER BY us, seq), 6) AS last_lag FROM (SELECT *, (us - pub_us) / 1e6 AS l FROM clk) GROUP BY ALL", "clk"),
    "lag_curve_decimated": chain(f"SELECT {K}, i AS position, {r('t')}, round((us - pub_us) / 1e6, 6) AS lag FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY us, seq) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS c FROM clk) WHERE list_contains(list_transform(range(20), lambda x: round_even(x * (c - 1) / 19.0::DOUBLE, 0)::BIGINT), i)", "clk"),
    "concurrency_classify": chain(f"SELECT {K}, {r('t_start')}, eligible, co_silent, co_topics, {r('concurrency')}, class FROM classed", "classed"),
    "merged_stalls": chain(f"SELECT mission_id, {r('t_start')}, {r('t_end')}, pieces, topics FROM stalls", "stalls"),
    "gap_stall_seconds": chain(f"SELECT s.mission_id, s.topic, round(stall_s, 4) AS stall_s FROM stalled s JOIN topics USING ({K}) WHERE ok", "stalled"),
    "rate_buckets": chain(f"SELECT {K}, k, {r('x')}, round(hz * 1000, 6) AS mhz FROM bk", "bk"),
    "rate_degradation": chain(f"SELECT {K}, {r('t_start')}, {r('t_end')}, {r('slope', 4)}, severity, round(hz_start * 1000, 4) AS mhz_start, round(hz_end * 1000, 4) AS mhz_end, episodes FROM drifts", "drifts"),
    "streaming_unassessable": chain(f"SELECT {K}, count(*) AS n, sum(coalesce(n < warm_n OR warm_n IS NULL OR n < 2 OR t - first_t <= 0 OR 1 / period > {C.aperiodic_ratio} * n / (t - first_t), true)::INT)::BIGINT AS blind FROM timed GROUP BY ALL", "timed"),
    "gap_ranking": chain(f"SELECT rank::INT AS rank, {K}, concurrency, duration_s FROM (SELECT {K}, round(concurrency, 6) AS concurrency, round(duration_s, 6) AS duration_s, row_number() OVER (PARTITION BY mission_id ORDER BY round(concurrency, 6) DESC, round(duration_s, 6) DESC, t_start, topic) AS rank FROM classed) WHERE rank <= 10", "classed"),
    "gap_stall_rollup": chain(f"SELECT {K}, count(*) AS n_gaps, count(st) AS absorbed FROM (SELECT g.mission_id, g.topic, g.gap, min(s.stall) AS st FROM vg g LEFT JOIN stalls s ON g.mission_id = s.mission_id AND g.t_start < s.t_end AND s.t_start < g.t_end AND least(g.t_end, s.t_end) - greatest(g.t_start, s.t_start) >= 0.8 * (g.t_end - g.t_start) GROUP BY ALL) GROUP BY ALL", "stalls"),
    "gap_nearest_interval": chain(f"SELECT {K}, {r('t_start')}, round(nearest, 6) AS nearest_start FROM (SELECT g.mission_id, g.topic, g.t_start, arg_min(e.t, abs(e.t - g.t_start) * 1e6 * 4 + CASE WHEN e.t > g.t_start THEN 1 ELSE 0 END) AS nearest FROM gaps g JOIN a e ON e.mission_id = g.mission_id AND e.topic = 'error' WHERE g.topic <> 'error' GROUP BY ALL)", "gaps"),
    "interval_union_seconds": chain("SELECT mission_id, count(*) AS pieces, round(sum(e - s), 4) AS seconds FROM (SELECT mission_id, i, min(t_start) AS s, max(t_end) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY mission_id ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN coalesce(t_start > max(t_end) OVER (PARTITION BY mission_id ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS f FROM gaps)) GROUP BY ALL) GROUP BY ALL", "gaps"),
    "density_timeline": chain("SELECT * FROM tl", "tl"),
    "coverage_fraction": chain("SELECT mission_id, covered, columns, round(covered / columns, 6) AS coverage FROM cov", "cov"),
    "topic_score": chain(f"SELECT {K}, status, n, n_gaps, {r('silent_s', 4)}, {r('stall_s', 4)}, {r('cv', 4)}, {r('drift', 4)}, {r('expected_hz')}, {r('observed_hz')}, score FROM health", "health"),
    "overall_verdict": chain(
        """SELECT mission_id, topics, assessed, messages, round(st, 4) AS stalled_s, round(least(1, p), 3) AS confidence, round(file_score, 4) AS file_score, round(sc, 4) AS score,
        CASE WHEN p < 1 THEN 'unassessable' WHEN least(sc, file_score) >= 85 THEN 'healthy' WHEN least(sc, file_score) >= 60 THEN 'degraded' ELSE 'compromised' END AS verdict
        FROM (SELECT *, least(assessed / topics / 0.25::DOUBLE, am / messages / 0.5::DOUBLE, coalesce(covok.covered, 0) / columns / 0.5::DOUBLE, te / 20.0::DOUBLE) AS p,
        greatest(0, (0.5::DOUBLE * worst + 0.3::DOUBLE * mean + 0.2::DOUBLE * file_score) * (1 - 2.5::DOUBLE * CASE WHEN te > 0 THEN least(1, st / te) ELSE 0 END)) AS sc
        FROM (SELECT h.mission_id, count(*) AS topics, sum((status = 'assessed')::INT)::BIGINT AS assessed, sum(n)::BIGINT AS messages, coalesce(sum(n) FILTER (status = 'assessed'), 0)::BIGINT AS am,
        coalesce(min(score) FILTER (status = 'assessed'), min(score)) AS worst, coalesce(avg(score) FILTER (status = 'assessed'), avg(score)) AS mean, max(t_end) AS te, max(stall_s) AS st
        FROM health h GROUP BY ALL) JOIN (SELECT mission_id, columns FROM cov) USING (mission_id) LEFT JOIN covok USING (mission_id) JOIN file USING (mission_id))""",
        "health",
    ),
    "audit_findings": chain(f"SELECT detector, severity, mission_id, topic, {r('t_start')}, {r('t_end')}, {r('value', 4)}, rolled_up FROM fs", "fs"),
    "related_findings": chain("SELECT mission_id, round(t_start, 6) AS t_start, count(o) AS related, coalesce(array_to_string(list_sort(list_distinct(list(o) FILTER (q <= 10))), ','), '') AS kinds FROM (SELECT s.mission_id, s.t_start, s.t_end, f.detector AS o, row_number() OVER (PARTITION BY s.mission_id, s.t_start, s.t_end ORDER BY f.severity DESC, f.t_start, f.detector, coalesce(f.topic, ''), f.t_end) AS q FROM fs s LEFT JOIN fs f ON f.mission_id = s.mission_id AND f.t_start <= s.t_end AND s.t_start <= f.t_end AND NOT (f.detector = 'stall' AND f.t_start = s.t_start AND f.t_end = s.t_end) WHERE s.detector = 'stall') GROUP BY mission_id, t_start, t_end", "fs"),
}
