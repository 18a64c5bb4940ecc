"""Queries of the series, log, spatial and attribution operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EVENTS as C
from tidemark.operators import attribution, clock, logs, redact, series, spatial
from tidemark.operators.intervals import merged
from tidemark.plans.detect import STEPS, K, _ends, _ia, _stalls, chain, r
from tidemark.sources.events import KEYS, arrivals, table

R6 = lambda c: F.round(c, 6).alias(c)
DAY = 86400.0
T = list(KEYS)


def resample_mean_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return series.resample(arrivals(spark, d), T, 3600.0).select(*T, "bin", R6("centre"), R6("mean"), "n")


def resample_empty_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.empty_runs(series.resample(arrivals(spark, d), T, 3600.0), T)


def describe_field(spark: SparkSession, d: str) -> DataFrame:
    out = series.describe(arrivals(spark, d), T)
    return out.select(*T, "n", *[R6(c) for c in out.columns if c not in (*T, "n")])


def json_field_stats(spark: SparkSession, d: str) -> DataFrame:
    out = series.describe(arrivals(spark, d).withColumn("v", F.col("k").cast("double")), T)
    return out.select(*T, "n", *[R6(c) for c in out.columns if c not in (*T, "n")])


def outliers_zscore(spark: SparkSession, d: str) -> DataFrame:
    return series.outliers_zscore(arrivals(spark, d), T, 2.5).select(*T, "seq", F.round("score", 4).alias("score"))


def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return series.outliers_iqr(arrivals(spark, d), T, 1.0).select(*T, "seq", F.round("score", 4).alias("score"))


def outliers_mad(spark: SparkSession, d: str) -> DataFrame:
    return series.outliers_mad(arrivals(spark, d), T, 3.0).select(*T, "seq", F.round("score", 4).alias("score"))


def changepoint_first(spark: SparkSession, d: str) -> DataFrame:
    return series.first_cut(arrivals(spark, d), T).select(*T, F.col("cut").cast("long").alias("cut"), F.round("gain", 2).alias("gain"))


def changepoints_all(spark: SparkSession, d: str) -> DataFrame:
    return series.changepoints(arrivals(spark, d), T).select(*T, "cut", R6("mean_before"), R6("mean_after"), R6("shift"))


def _binned(spark, d, topic):
    b = series.resample(arrivals(spark, d).where(F.col("topic") == topic), ["topic"], 21600.0)
    return b.select(F.col("bin").alias("i"), F.col("mean").alias("v"))


def cross_correlate_lag(spark: SparkSession, d: str) -> DataFrame:
    return series.cross_correlation(_binned(spark, d, "click"), _binned(spark, d, "view"), 5).select("lag", F.round("r", 5).alias("r"))


def correlate_signals(spark: SparkSession, d: str) -> DataFrame:
    """Whether clicks lead views or follow them, by bins of six hours."""
    out = series.correlation(_binned(spark, d, "click"), _binned(spark, d, "view"), 21600.0, 108000.0)
    return out.select("lag_s", F.round("r", 5).alias("r"), "relation")


def outliers_mad_short(spark: SparkSession, d: str) -> DataFrame:
    """Outliers of each user's values, whose series are shorter than the window."""
    return series.outliers_mad(arrivals(spark, d), ["user_id"], 3.0).select("user_id", "seq", F.round("score", 4).alias("score"))


def _sided(spark, d):
    a = arrivals(spark, d)
    half = a.groupBy("mission_id").agg((F.max("t") / 2).alias("h"))
    return a.join(half, "mission_id").withColumn("side", F.when(F.col("t") < F.col("h"), "a").otherwise("b"))


def compare_windows(spark: SparkSession, d: str) -> DataFrame:
    out = series.two_groups(_sided(spark, d), T)
    return out.select(*T, "n_a", "n_b", R6("mean_a"), R6("mean_b"), R6("d"), "magnitude")


def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return series.ks(_sided(spark, d), T).select(*T, R6("ks"))


def ewma_interarrival(spark: SparkSession, d: str) -> DataFrame:
    return series.ewma(_ia(spark, d).where("dt > 0"), T, C.ewma).select(*T, F.round("ewma", 4).alias("ewma"))


def theil_sen_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend of each topic's daily mean value."""
    daily = arrivals(spark, d).groupBy(*T, F.floor(F.col("t") / DAY).alias("x")).agg(F.round(F.avg("v"), 6).alias("y"))
    return series.slopes(daily, T).select(*T, "n", R6("slope"), R6("tau"), "significant")


def rate_bucket_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend of each topic's daily rate."""
    daily = arrivals(spark, d).groupBy(*T, F.floor(F.col("t") / DAY).alias("x")).agg((F.count("*") / DAY).alias("y"))
    return series.slopes(daily, T).select(*T, "n", F.round(F.col("slope") * 1e6, 6).alias("slope_e6"), R6("tau"), "significant")


def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*T).orderBy("us", "seq").rowsBetween(-49, 0)
    return arrivals(spark, d).select(*T, "seq", F.round(F.avg("v").over(w), 8).alias("mean"), F.round(F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)), 6).alias("std"))


def median_absolute_deviation(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    m = a.groupBy(*T).agg(F.percentile("v", 0.5).alias("m"))
    return a.join(m, T).groupBy(*T).agg(F.round(F.percentile(F.abs(F.col("v") - F.col("m")), 0.5), 6).alias("mad"))


def nearest_message(spark: SparkSession, d: str) -> DataFrame:
    """The arrival of each topic nearest to the tenth hour, within two hours."""
    near = F.abs(F.col("t") - 36000.0)
    a = arrivals(spark, d).where(near <= 7200.0)
    return a.groupBy(*T).agg(F.min_by("seq", F.struct(near, "us", "seq")).alias("seq"), F.round(F.min(near), 6).alias("off_s"))


def decimated_sample(spark: SparkSession, d: str) -> DataFrame:
    first = arrivals(spark, d).withColumn("_r", F.row_number().over(Window.partitionBy(*T).orderBy("us", "seq"))).where("_r <= 2001")
    return clock.decimated(first, T, ["us", "seq"], 20).select(*T, "position", "seq")


def redacted_projection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("topic"), F.struct("user_id", "value").alias("payload"))
    out = redact.redacted(e, topics=["err*"], fields=["payload.user_id"])
    return out.select("event_id", "topic", F.col("payload.user_id").alias("user_id"), F.col("payload.value").alias("value"))


def topic_time_window(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d).where(F.col("topic").isin("click", "view") & F.col("t").between(86400.0, 172800.0))
    return a.select(*T, "seq", R6("t"))


def _lines(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("role").alias("level"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("node"), (F.col("conv_id") * 10.0 + F.col("turn")).alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("msg"))


def log_template_cluster(spark: SparkSession, d: str) -> DataFrame:
    return logs.clusters(_lines(spark, d))


def log_filter_levels(spark: SparkSession, d: str) -> DataFrame:
    return logs.matching(_lines(spark, d), node="conv1", pattern="th[ea]", start=10.0).groupBy("level").agg(F.count("*").alias("n"))


def log_burst(spark: SparkSession, d: str) -> DataFrame:
    """Per user and topic, as arrivals stand for log lines; the events have no bursts of three times the mean."""
    return logs.bursts(arrivals(spark, d), [*T, "user_id"], 1.5).select(*T, "user_id", "n", F.round("centre", 2).alias("centre"))


def event_timeline_union(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    hot = series.outliers_zscore(a, T, 2.5).select(F.lit("outlier").alias("kind"), "mission_id", "topic", "t", F.lit(3).alias("severity"))
    err = a.where("topic = 'error'").select(F.lit("error").alias("kind"), "mission_id", "topic", "t", F.lit(2).alias("severity"))
    return hot.unionByName(err).orderBy("t", "kind", "topic", "mission_id").limit(200).select("kind", *T, R6("t"), "severity")


def log_signal_coincidence(spark: SparkSession, d: str) -> DataFrame:
    """Errors within five minutes of an outlier of any topic."""
    a = arrivals(spark, d)
    o = series.outliers_zscore(a, T, 2.5).select("mission_id", F.col("t").alias("ot"))
    return logs.near(a.where("topic = 'error'"), o, ["mission_id"], 300.0).select("mission_id", "seq", R6("t"))


def _points(spark, d):
    a = arrivals(spark, d)
    return a.select(*T, "us", "seq", "t", F.col("v").alias("x"), (F.col("seq") % 100 / F.lit(10.0)).alias("y"), F.lit(0.0).alias("z"))


def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.summary(_points(spark, d), T)
    return out.select(*T, "n", *[F.round(c, 4).alias(c) for c in ("length", "max_speed", "min_x", "max_x", "min_y", "max_y", "displacement")])


def stops(spark: SparkSession, d: str) -> DataFrame:
    return spatial.stops(_points(spark, d), T, 0.02, 60.0).select(*T, R6("t_start"), R6("t_end"))


def curvature(spark: SparkSession, d: str) -> DataFrame:
    return spatial.curvature(_points(spark, d), T).select(*T, F.round("mean_curvature", 4).alias("mean_curvature"))


def plan_deviation(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.range(10).select((F.col("id") * 10.0).alias("px"), (F.col("id") * 1.0).alias("py"))
    return spatial.deviation(_points(spark, d), plan, T).select(*T, F.round("mean_deviation", 4).alias("mean_deviation"), F.round("max_deviation", 4).alias("max_deviation"))


def _transforms(spark, d):
    return arrivals(spark, d).select(F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("parent"), F.concat(F.lit("f"), (F.col("user_id") % 7 + 1 + F.col("seq") % 2).cast("string")).alias("child"), "us", "seq", "t", F.col("v").alias("x"), F.col("k").cast("double").alias("y"))


def tf_edges(spark: SparkSession, d: str) -> DataFrame:
    return spatial.edges(_transforms(spark, d)).select("parent", "child", "n", *[R6(c) for c in ("first_t", "last_t", "max_gap")], "jumps")


def tf_roots(spark: SparkSession, d: str) -> DataFrame:
    return spatial.roots(_transforms(spark, d))


def stall_pattern_dispersion(spark: SparkSession, d: str) -> DataFrame:
    out = attribution.dispersion(_stalls(spark, d), _ends(arrivals(spark, d)), DAY)
    return out.select("mission_id", "n", R6("index"), "pattern")


def stall_attribution(spark: SparkSession, d: str) -> DataFrame:
    m = merged(_stalls(spark, d), ["mission_id"], "t_start", "t_end")
    m = m.withColumn("stall", F.row_number().over(Window.partitionBy("mission_id").orderBy("t_start")))
    out = attribution.attribution(arrivals(spark, d), m, T, 7200.0, 3600.0, 3600.0)
    return out.select(*T, "n_pre", "n_base", F.round("d", 4).alias("d"), F.round("consistency", 4).alias("consistency"), "verdict")


def payload_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the payload as rows."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))


QUERIES = {f.__name__: f for f in (resample_mean_with_gaps, resample_empty_runs, describe_field, json_field_stats, outliers_zscore, outliers_iqr, outliers_mad, changepoint_first, changepoints_all, cross_correlate_lag, correlate_signals, outliers_mad_short, compare_windows, ks_statistic, ewma_interarrival, theil_sen_trend, rate_bucket_trend, rolling_stats, median_absolute_deviation, nearest_message, decimated_sample, redacted_projection, topic_time_window, log_template_cluster, log_filter_levels, log_burst, event_timeline_union, log_signal_coincidence, trajectory_summary, stops, curvature, plan_deviation, tf_edges, tf_roots, stall_pattern_dispersion, stall_attribution, payload_flatten)}

STEPS |= {
    "span": f"SELECT {K}, min(t) AS t0, greatest(1, ceil((max(t) - min(t)) / 3600.0))::BIGINT AS nb FROM a GROUP BY ALL",
    "filled": f"SELECT {K}, least(floor((t - t0) / 3600.0)::BIGINT, nb - 1) AS bin, avg(v) AS mean, count(v) AS n FROM a JOIN span USING ({K}) GROUP BY ALL",
    "bins": f"SELECT {K}, t0, unnest(range(nb)) AS bin FROM span",
    "rs": f"SELECT {K}, bin, t0 + (bin + 0.5) * 3600.0 AS centre, mean, coalesce(n, 0) AS n FROM bins LEFT JOIN filled USING ({K}, bin)",
    "zs": f"SELECT a.*, abs((v - m) / sd) AS score FROM a JOIN (SELECT {K}, avg(v) AS m, stddev_samp(v) AS sd FROM a GROUP BY ALL HAVING count(v) >= 3 AND stddev_samp(v) > 0) USING ({K}) WHERE abs((v - m) / sd) > 2.5",
    "iq": f"SELECT {K}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM a GROUP BY ALL HAVING count(v) >= 4",
    "mw": f"SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY {K}) AS c, list(v) OVER (PARTITION BY {K} ORDER BY us, seq ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS l, first_value(v) OVER w AS fv, last_value(v) OVER (PARTITION BY {K} ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM a WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "mp": "SELECT *, list_concat(list_concat(list_transform(range(greatest(0, 51 - i)), lambda x: fv), l), list_transform(range(greatest(0, 50 - (c - i))), lambda x: lv)) AS p FROM mw WHERE c >= 101",
    "mm": "SELECT *, list_sort(p)[51] AS med FROM mp",
    "mz": "SELECT *, list_sort(list_transform(p, lambda x: abs(x - med)))[51] AS mad FROM mm",
    "mu": "SELECT user_id, seq, v, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM a",
    "ml": "SELECT user_id, list(v ORDER BY us, seq) AS l FROM a GROUP BY ALL",
    "mh": "SELECT user_id, seq, v, list_transform(range(-h, h + 1), lambda j: l[greatest(1, least(c, i + j))]) AS p, h FROM (SELECT mu.*, l, greatest(5, least(101, CASE WHEN c % 2 = 1 THEN c ELSE c - 1 END)) // 2 AS h FROM mu JOIN ml USING (user_id) WHERE c >= 5)",
    "mk": "SELECT *, list_sort(p)[h + 1] AS med FROM mh",
    "mj": "SELECT *, list_sort(list_transform(p, lambda x: abs(x - med)))[h + 1] AS mad FROM mk",
    "cp": f"SELECT *, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY {K}) AS c, sum(v) OVER (PARTITION BY {K}) AS al FROM a WINDOW w AS (PARTITION BY {K} ORDER BY us, seq ROWS UNBOUNDED PRECEDING)",
    "sided": "SELECT a.*, CASE WHEN t < h THEN 'a' ELSE 'b' END AS side FROM a JOIN (SELECT mission_id, max(t) / 2 AS h FROM a GROUP BY ALL) USING (mission_id)",
    "kc": f"SELECT {K}, v, sum((side = 'a')::INT) AS na, sum((side = 'b')::INT) AS nb FROM sided GROUP BY ALL",
    "dv": f"SELECT {K}, floor(t / 86400.0)::BIGINT AS x, round(avg(v), 6) AS y, count(*) / 86400.0::DOUBLE AS rate FROM a GROUP BY ALL",
    "pts": f"SELECT {K}, us, seq, t, v AS x, (seq % 100) / 10.0::DOUBLE AS y FROM a",
    "stp": f"SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM pts WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "spd": "SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt END AS speed FROM stp",
    "st1": f"SELECT *, (speed < 0.02)::INT AS still, coalesce(lead(t) OVER (PARTITION BY {K} ORDER BY us, seq), t) AS next_t FROM spd WHERE speed IS NOT NULL",
    "st2": f"SELECT *, CASE WHEN still <> lag(still, 1, 0) OVER (PARTITION BY {K} ORDER BY us, seq) THEN 1 ELSE 0 END AS flip FROM st1",
    "st3": f"SELECT *, sum(flip) OVER (PARTITION BY {K} ORDER BY us, seq) AS run FROM st2",
    "cu": f"SELECT *, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM pts WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)",
    "tr": "SELECT 'f' || (user_id % 7) AS parent, 'f' || (user_id % 7 + 1 + seq % 2) AS child, us, seq, t, v AS x, k::DOUBLE AS y FROM a",
    "ln": "SELECT role AS level, 'conv' || conv_id AS node, conv_id * 10.0::DOUBLE + turn AS t, conv_id * 1000 + turn AS id, text AS msg FROM conversations",
    "m1": f"SELECT *, CASE WHEN coalesce(t_start > max(t_end) OVER (PARTITION BY mission_id ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS f FROM stalls",
    "m2": "SELECT *, sum(f) OVER (PARTITION BY mission_id ORDER BY t_start, t_end) AS i FROM m1",
    "ms": "SELECT mission_id, i AS stall, min(t_start) AS t_start, max(t_end) AS t_end FROM m2 GROUP BY ALL",
    "cl": f"SELECT {K}, v, seq, max(coalesce(t >= t_start AND t <= t_end, false)) AS ins, min(CASE WHEN t < t_start AND t >= t_start - 7200.0 THEN stall END) AS pre, max(coalesce(t >= t_start - 3600.0 AND t <= t_end + 3600.0, false)) AS grd FROM (SELECT a.*, s.stall, s.t_start, s.t_end FROM a LEFT JOIN ms s ON s.mission_id = a.mission_id AND a.t >= s.t_start - 7200.0 AND a.t <= s.t_end + 3600.0) GROUP BY ALL",
    "cls": "SELECT *, CASE WHEN ins THEN 'inside' WHEN pre IS NOT NULL THEN 'pre' WHEN grd THEN 'guard' ELSE 'base' END AS class FROM cl",
    "sums": f"SELECT {K}, count(v) FILTER (class = 'pre') AS n_pre, count(v) FILTER (class = 'base') AS n_base, avg(v) FILTER (class = 'pre') AS m_pre, avg(v) FILTER (class = 'base') AS m_base, var_samp(v) FILTER (class = 'pre') AS v_pre, var_samp(v) FILTER (class = 'base') AS v_base FROM cls GROUP BY ALL",
    "each": f"SELECT {K}, pre, avg(v) AS sm FROM cls WHERE class = 'pre' GROUP BY ALL HAVING count(v) >= 2",
    "shift": f"SELECT {K}, count(*) AS stalls, avg((sign(sm - m_base) = sign(m_pre - m_base))::INT::DOUBLE) AS consistency FROM each JOIN sums USING ({K}) GROUP BY ALL",
}

STEPS["ct0"] = f"SELECT {K}, 0::BIGINT AS cut FROM a WHERE false"
STEPS["ci"] = f"SELECT {K}, v, row_number() OVER (PARTITION BY {K} ORDER BY us, seq) AS i FROM a"
for _k in range(1, 7):  # the sixth only cuts rows into segments
    STEPS[f"cs{_k}"] = f"SELECT ci.mission_id, ci.topic, ci.v, ci.i, count(z.cut) AS seg FROM ci LEFT JOIN ct{_k - 1} z ON z.mission_id = ci.mission_id AND z.topic = ci.topic AND z.cut < ci.i GROUP BY ALL"
    STEPS[f"cg{_k}"] = f"SELECT {K}, i, s * s / j + (al - s) * (al - s) / (n - j) - al * al / n AS gain FROM (SELECT *, row_number() OVER w AS j, sum(v) OVER w AS s, count(*) OVER p AS n, sum(v) OVER p AS al FROM cs{_k} WINDOW w AS (PARTITION BY {K}, seg ORDER BY i), p AS (PARTITION BY {K}, seg)) WHERE j >= 20 AND n - j >= 20"
    STEPS[f"ct{_k}"] = f"SELECT {K}, cut FROM ct{_k - 1} UNION ALL SELECT {K}, i FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY gain DESC, i) AS q FROM cg{_k}) WHERE q = 1 AND gain > 0"
STEPS["cm"] = f"SELECT {K}, seg, max(i) AS last, avg(v) AS m FROM cs6 GROUP BY ALL"

_DESC = ", ".join([r("min"), r("max"), r("mean"), r("std"), *[r(f"p{round(q * 100):02d}") for q in series.PERCENTILES]])


def _describe(v: str) -> str:
    q = ", ".join(f"quantile_cont({v}, {q}) AS p{round(q * 100):02d}" for q in series.PERCENTILES)
    return chain(f"SELECT {K}, n, {_DESC} FROM (SELECT {K}, count({v}) AS n, min({v}) AS min, max({v}) AS max, avg({v}) AS mean, stddev_samp({v}) AS std, {q} FROM a GROUP BY ALL)", "a")


def _slope(y: str, out: str) -> str:
    return chain(
        f"""SELECT {K}, n, {out}, round(tau, 6) AS tau, n >= 4 AND abs(tau) / sqrt(2.0::DOUBLE * (2 * n + 5) / (9.0::DOUBLE * n * (n - 1))) > 1.959963984540054::DOUBLE AS significant
        FROM (SELECT p.*, c.n, CASE WHEN c.n >= 4 AND d > 0 THEN s / d ELSE 0 END AS tau FROM (SELECT p.mission_id, p.topic, quantile_cont((q.{y} - p.{y}) / (q.x - p.x), 0.5) AS slope, sum(sign(q.{y} - p.{y})) AS s, sum(abs(sign(q.{y} - p.{y}))) AS d
        FROM dv p JOIN dv q ON p.mission_id = q.mission_id AND p.topic = q.topic AND p.x < q.x GROUP BY ALL) p JOIN (SELECT {K}, count(*) AS n FROM dv GROUP BY ALL) c USING ({K}))""",
        "dv",
    )


def _six(topic: str) -> str:
    return f"""(SELECT bin AS i, v FROM (SELECT unnest(range(nb)) AS bin FROM (SELECT greatest(1, ceil((max(t) - min(t)) / 21600.0))::BIGINT AS nb FROM a WHERE topic = '{topic}'))
    LEFT JOIN (SELECT least(floor((t - t0) / 21600.0)::BIGINT, nb - 1) AS bin, avg(v) AS v FROM (SELECT t, v, min(t) OVER () AS t0, greatest(1, ceil((max(t) OVER () - min(t) OVER ()) / 21600.0))::BIGINT AS nb FROM a WHERE topic = '{topic}') GROUP BY ALL) USING (bin))"""


_TPL = "msg"
for _p, _n in logs.ABSTRACTED:
    if _n == "<num>":  # no look-around here: the characters around a number are put back, in two turns as neighbours share one
        for _ in range(2):
            _TPL = f"regexp_replace({_TPL}, '(^|[^\\p{{L}}\\p{{N}}_.])[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?($|[^\\p{{L}}\\p{{N}}_.])', '\\1<num>\\4', 'g')"
    else:
        _TPL = "regexp_replace({}, '{}', '{}', 'g')".format(_TPL, _p.replace("'", "''"), _n)

SQL = {
    "resample_mean_with_gaps": chain(f"SELECT {K}, bin, {r('centre')}, {r('mean')}, n FROM rs", "rs"),
    "resample_empty_runs": chain(f"SELECT {K}, min(bin) AS first_bin, max(bin) AS last_bin FROM (SELECT *, bin - row_number() OVER (PARTITION BY {K} ORDER BY bin) AS g FROM rs WHERE n = 0) GROUP BY mission_id, topic, g", "rs"),
    "describe_field": _describe("v"),
    "json_field_stats": _describe("k::DOUBLE"),
    "outliers_zscore": chain(f"SELECT {K}, seq, {r('score', 4)} FROM zs", "zs"),
    "outliers_iqr": chain(f"SELECT {K}, seq, round(abs(v - q2) / (q3 - q1), 4) AS score FROM a JOIN iq USING ({K}) WHERE q3 > q1 AND (v < q1 - 1.0 * (q3 - q1) OR v > q3 + 1.0 * (q3 - q1))", "iq"),
    "outliers_mad": chain(f"SELECT {K}, seq, round(abs(v - med) / (1.4826::DOUBLE * mad), 4) AS score FROM mz WHERE mad > 0 AND abs(v - med) / (1.4826::DOUBLE * mad) > 3.0", "mz"),
    "changepoint_first": chain(f"SELECT {K}, i AS cut, round(gain, 2) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY gain DESC, i) AS q FROM (SELECT {K}, i, round(s * s / i + (al - s) * (al - s) / (c - i) - al * al / c, 4) AS gain FROM cp WHERE i >= 20 AND c - i >= 20)) WHERE q = 1", "cp"),
    "changepoints_all": chain("SELECT x.mission_id, x.topic, x.last AS cut, round(x.m, 6) AS mean_before, round(y.m, 6) AS mean_after, round(y.m - x.m, 6) AS shift FROM cm x JOIN cm y ON x.mission_id = y.mission_id AND x.topic = y.topic AND y.seg = x.seg + 1", "cm"),
    "cross_correlate_lag": chain(
        f"""SELECT lag, round(s / sqrt(px * py), 5) AS r FROM (SELECT l AS lag, sum(x.x * y.x) AS s FROM (SELECT unnest(range(-5, 6)) AS l), x0 x JOIN y0 y ON y.i = x.i + l GROUP BY ALL), (SELECT sum(x * x) AS px FROM x0), (SELECT sum(x * x) AS py FROM y0)""".replace("FROM (SELECT l AS lag", "FROM (WITH n AS (SELECT least((SELECT max(i) FROM " + _six("click") + "), (SELECT max(i) FROM " + _six("view") + ")) AS n), x1 AS (SELECT * FROM " + _six("click") + " WHERE i <= (SELECT n FROM n)), y1 AS (SELECT * FROM " + _six("view") + " WHERE i <= (SELECT n FROM n)), x0 AS (SELECT i, coalesce(v, (SELECT avg(v) FROM x1)) - (SELECT avg(v) FROM x1) AS x FROM x1), y0 AS (SELECT i, coalesce(v, (SELECT avg(v) FROM y1)) - (SELECT avg(v) FROM y1) AS x FROM y1) SELECT (SELECT sum(x * x) FROM x0) AS px, (SELECT sum(x * x) FROM y0) AS py, l AS lag").replace(", (SELECT sum(x * x) AS px FROM x0), (SELECT sum(x * x) AS py FROM y0)", ""),
        "a",
    ),
    "outliers_mad_short": chain("SELECT user_id, seq, round(abs(v - med) / (1.4826::DOUBLE * mad), 4) AS score FROM mj WHERE mad > 0 AND abs(v - med) / (1.4826::DOUBLE * mad) > 3.0", "mj"),
    "compare_windows": chain(f"SELECT {K}, n_a, n_b, {r('mean_a')}, {r('mean_b')}, {r('d')}, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM (SELECT *, CASE WHEN n_a >= 2 AND n_b >= 2 AND ((n_a - 1) * va + (n_b - 1) * vb) > 0 THEN (mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) ELSE 0 END AS d FROM (SELECT {K}, count(v) FILTER (side = 'a') AS n_a, count(v) FILTER (side = 'b') AS n_b, avg(v) FILTER (side = 'a') AS mean_a, avg(v) FILTER (side = 'b') AS mean_b, var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb FROM sided GROUP BY ALL))", "sided"),
    "ks_statistic": chain(f"SELECT {K}, round(coalesce(max(g), 0), 6) AS ks FROM (SELECT {K}, abs(sum(na) OVER o / sum(na) OVER w - sum(nb) OVER o / sum(nb) OVER w) AS g FROM kc WINDOW o AS (PARTITION BY {K} ORDER BY v), w AS (PARTITION BY {K})) GROUP BY ALL", "kc"),
    "ewma_interarrival": chain(f"SELECT {K}, round(list_reduce(list(dt ORDER BY us, seq), lambda acc, x: acc + {C.ewma}::DOUBLE * (x - acc)), 4) AS ewma FROM ia WHERE dt > 0 GROUP BY ALL", "ia"),
    "theil_sen_trend": _slope("y", "round(slope, 6) AS slope"),
    "rate_bucket_trend": _slope("rate", "round(slope * 1e6, 6) AS slope_e6"),
    "rolling_stats": chain(f"SELECT {K}, seq, round(avg(v) OVER w, 8) AS mean, round(coalesce(stddev_samp(v) OVER w, 0), 6) AS std FROM a WINDOW w AS (PARTITION BY {K} ORDER BY us, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "a"),
    "median_absolute_deviation": chain(f"SELECT {K}, round(mad(v), 6) AS mad FROM a GROUP BY ALL", "a"),
    "nearest_message": chain(f"SELECT {K}, seq, round(off, 6) AS off_s FROM (SELECT *, abs(t - 36000.0) AS off, row_number() OVER (PARTITION BY {K} ORDER BY abs(t - 36000.0), us, seq) AS q FROM a WHERE abs(t - 36000.0) <= 7200.0) WHERE q = 1", "a"),
    "decimated_sample": chain(f"SELECT {K}, i AS position, seq FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS c FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY us, seq) - 1 AS i FROM a) WHERE i <= 2000) WHERE list_contains(list_transform(range(20), lambda x: round_even(x * (c - 1) / 19.0::DOUBLE, 0)::BIGINT), i)", "a"),
    "redacted_projection": "SELECT event_id, event_type AS topic, '[redacted]' AS user_id, value FROM events WHERE event_type NOT LIKE 'err%'",
    "topic_time_window": chain(f"SELECT {K}, seq, {r('t')} FROM a WHERE topic IN ('click', 'view') AND t BETWEEN 86400.0 AND 172800.0", "a"),
    "log_template_cluster": chain(f"SELECT level, template, sum(n)::BIGINT AS n, min(first_t) AS first_t, max(last_t) AS last_t, first(example ORDER BY first_t, first_id) AS example FROM (SELECT level, CASE WHEN row_number() OVER (ORDER BY first_t, first_id) > 200 THEN '<other>' ELSE template END AS template, n, first_t, last_t, first_id, example FROM (SELECT level, trim({_TPL}) AS template, count(*) AS n, min(t) AS first_t, max(t) AS last_t, arg_min(id, (t, id)) AS first_id, arg_min(msg, (t, id)) AS example FROM ln GROUP BY ALL)) GROUP BY ALL", "ln"),
    "log_filter_levels": chain("SELECT level, count(*) AS n FROM ln WHERE contains(node, 'conv1') AND regexp_matches(msg, '(?i)th[ea]') AND t >= 10.0 GROUP BY ALL", "ln"),
    "log_burst": chain(f"SELECT {K}, user_id, n, round(lo + (b + 0.5) * (hi - lo) / bins, 2) AS centre FROM (SELECT *, row_number() OVER (PARTITION BY {K}, user_id ORDER BY c DESC, b) AS q FROM (SELECT {K}, user_id, n, lo, hi, bins, least(floor((t - lo) / ((hi - lo) / bins)), bins - 1) AS b, count(*) AS c FROM a JOIN (SELECT {K}, user_id, count(*) AS n, min(t) AS lo, max(t) AS hi, least(20, greatest(4, floor(count(*) / 3))) AS bins FROM a GROUP BY ALL HAVING count(*) > 4 AND max(t) > min(t)) USING ({K}, user_id) GROUP BY ALL)) WHERE q = 1 AND c > 1.5::DOUBLE * n / bins", "a"),
    "event_timeline_union": chain(f"SELECT kind, {K}, round(t, 6) AS t, severity FROM (SELECT 'outlier' AS kind, {K}, t, 3 AS severity FROM zs UNION ALL SELECT 'error', {K}, t, 2 FROM a WHERE topic = 'error') ORDER BY t, kind, topic, mission_id LIMIT 200", "zs"),
    "log_signal_coincidence": chain("SELECT mission_id, seq, round(t, 6) AS t FROM a WHERE topic = 'error' AND EXISTS (SELECT 1 FROM zs WHERE zs.mission_id = a.mission_id AND abs(zs.t - a.t) <= 300.0)", "zs"),
    "trajectory_summary": chain(f"SELECT {K}, count(*) AS n, round(sum(step), 4) AS length, round(max(speed), 4) AS max_speed, round(min(x), 4) AS min_x, round(max(x), 4) AS max_x, round(min(y), 4) AS min_y, round(max(y), 4) AS max_y, round(sqrt(pow(last(x ORDER BY us, seq) - first(x ORDER BY us, seq), 2) + pow(last(y ORDER BY us, seq) - first(y ORDER BY us, seq), 2)), 4) AS displacement FROM spd GROUP BY ALL", "spd"),
    "stops": chain(f"SELECT {K}, round(min(t), 6) AS t_start, round(max(next_t), 6) AS t_end FROM st3 WHERE still = 1 GROUP BY mission_id, topic, run HAVING max(next_t) - min(t) >= 60.0", "st3"),
    "curvature": chain(f"SELECT {K}, round(avg(CASE WHEN p > 1e-12 THEN 2 * cr / p ELSE 0 END), 4) AS mean_curvature FROM (SELECT {K}, abs((x - xp) * (yn - yp) - (y - yp) * (xn - xp)) AS cr, sqrt(pow(x - xp, 2) + pow(y - yp, 2)) * sqrt(pow(xn - x, 2) + pow(yn - y, 2)) * sqrt(pow(xn - xp, 2) + pow(yn - yp, 2)) AS p FROM cu WHERE xp IS NOT NULL AND xn IS NOT NULL) GROUP BY ALL", "cu"),
    "plan_deviation": chain(f"SELECT {K}, round(avg(d), 4) AS mean_deviation, round(max(d), 4) AS max_deviation FROM (SELECT {K}, seq, min(sqrt(pow(x - i * 10.0, 2) + pow(y - i, 2))) AS d FROM pts, range(10) p(i) GROUP BY ALL) GROUP BY ALL", "pts"),
    "tf_edges": chain("SELECT parent, child, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(max(g), 6) AS max_gap, sum((coalesce(j, 0) > 1)::INT)::BIGINT AS jumps FROM (SELECT *, t - lag(t) OVER w AS g, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS j FROM tr WINDOW w AS (PARTITION BY parent, child ORDER BY us, seq)) GROUP BY ALL", "tr"),
    "tf_roots": chain("SELECT DISTINCT parent FROM tr WHERE parent NOT IN (SELECT child FROM tr)", "tr"),
    "stall_pattern_dispersion": chain("SELECT mission_id, n, round(idx, 6) AS index, CASE WHEN n < 4 OR e <= 86400 THEN 'unknown' WHEN idx > 2 THEN 'clustered' WHEN idx < 0.5 THEN 'periodic' ELSE 'random' END AS pattern FROM (SELECT mission_id, coalesce(sum(c), 0)::BIGINT AS n, var_pop(coalesce(c, 0)) / avg(coalesce(c, 0)) AS idx, max(t_end) AS e FROM (SELECT mission_id, t_end, unnest(range(floor(t_end / 86400.0)::BIGINT + 1)) AS w FROM ends) LEFT JOIN (SELECT mission_id, floor(t_start / 86400.0)::BIGINT AS w, count(*) AS c FROM stalls GROUP BY ALL) USING (mission_id, w) GROUP BY ALL)", "stalls"),
    "stall_attribution": chain(f"SELECT {K}, n_pre, n_base, round(d, 4) AS d, round(consistency, 4) AS consistency, CASE WHEN d IS NULL THEN 'no_data' WHEN abs(d) >= 0.5 AND consistency >= 0.7 AND stalls >= 3 THEN 'attributed' ELSE 'unexplained' END AS verdict FROM (SELECT *, CASE WHEN n_pre >= 10 AND n_base >= 50 AND v_pre + v_base > 0 THEN greatest(-10, least(10, (m_pre - m_base) / sqrt((v_pre + v_base) / 2))) END AS d FROM sums LEFT JOIN shift USING ({K}))", "shift"),
    "payload_flatten": "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events",
}
SQL["correlate_signals"] = SQL["cross_correlate_lag"].replace("SELECT lag, round(s / sqrt(px * py), 5) AS r FROM", "SELECT lag * 21600.0::DOUBLE AS lag_s, round(r, 5) AS r, CASE WHEN abs(r) < 0.3 THEN 'none' WHEN lag = 0 THEN 'together' WHEN lag > 0 THEN 'a leads' ELSE 'b leads' END AS relation FROM (SELECT lag, s / sqrt(px * py) AS r FROM", 1) + ") ORDER BY round(abs(r), 9) DESC, lag LIMIT 1"
