"""Fleet, gate and relational queries over the star schema, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import fleet, gate, qos, series
from tidemark.operators.series import dtw_rank as dtw_rank_op
from tidemark.plans.detect import STEPS, K, _gaps, _stalls, chain, r
from tidemark.sources.events import KEYS, arrivals, table

R = lambda c, n=6: F.round(c, n).alias(c)


def _missions(spark, d):
    """A customer as a unit and an order as a recording."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("tag"))


def fleet_summary(spark: SparkSession, d: str) -> DataFrame:
    return _missions(spark, d).agg(F.count("*").alias("missions"), F.countDistinct("unit").alias("units"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return _missions(spark, d).groupBy("verdict", "tag").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def missions_filtered_page(spark: SparkSession, d: str) -> DataFrame:
    m = _missions(spark, d).where("verdict = 'F' and value >= 1000")
    heavy = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("id"))
    return fleet.page(m.join(heavy, "id", "left_semi"), [F.desc_nulls_last("day"), F.col("id")], 20, 50).select("id", "unit", "value")


def mission_search(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_name")
    tags = s.join(n, "nation").select("id", "n_name")
    return fleet.search(s, "id", ["name"], [(tags, "n_name")], "1").select("id", "name")


def cohort_compare(spark: SparkSession, d: str) -> DataFrame:
    out = fleet.cohorts(_missions(spark, d), "tag", "value")
    return out.select("tag", "n", R("mean", 4), R("std", 4), R("median", 4))


def cohort_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Means and effect size before and after a date."""
    side = _missions(spark, d).select("verdict", F.when(F.col("day") < F.lit("1995-06-01").cast("timestamp_ntz"), "a").otherwise("b").alias("side"), F.col("value").alias("v"))
    out = series.two_groups(side, ["verdict"])
    return out.select("verdict", "n_a", "n_b", R("mean_a", 4), R("mean_b", 4), R("d"), "magnitude")


def rank_metric(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lines"))
    m = _missions(spark, d).join(lines, "id", "left").select("id", F.coalesce("lines", F.lit(0)).alias("lines"), "value")
    return m.orderBy(F.desc("lines"), F.desc("value"), "id").limit(25)


def regression_scan(spark: SparkSession, d: str) -> DataFrame:
    """The trend of each verdict's monthly mean."""
    month = F.year("day") * 12 + F.month("day")
    pts = _missions(spark, d).groupBy("verdict", month.cast("double").alias("x")).agg(F.round(F.avg("value"), 4).alias("y"))
    return fleet.trends(pts, ["verdict"]).select("verdict", "n", R("slope", 4), R("tau"), "significant", R("mad", 4), "trend")


def _features(spark, d):
    a = arrivals(spark, d)
    return a.groupBy("user_id").agg(F.log1p(F.count("*").cast("double")).alias("f1"), F.avg("v").alias("f2"), F.log1p(F.max("t") - F.min("t")).alias("f3"), F.array_sort(F.collect_set("topic")).alias("topics"), F.array_sort(F.collect_set("k")).alias("templates"))


def mission_similarity(spark: SparkSession, d: str) -> DataFrame:
    return fleet.similarity(_features(spark, d), "user_id", ["f1", "f2", "f3"], "topics", "templates", 1).select("user_id", R("similarity", 5))


def signal_diff(spark: SparkSession, d: str) -> DataFrame:
    """The values of two units by topic."""
    a = arrivals(spark, d).where("user_id in (1, 2)").withColumn("side", F.when(F.col("user_id") == 1, "a").otherwise("b"))
    out = series.two_groups(a, ["topic"]).join(series.ks(a, ["topic"]), "topic")
    pct = F.when(F.col("mean_a") != 0, (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100).otherwise(0.0)
    return out.where("n_a > 0 and n_b > 0").select("topic", R("mean_a"), R("mean_b"), F.round(pct, 4).alias("percent"), R("d", 5), R("ks"), "magnitude")


def topic_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Values of the payload that one unit has and another lacks."""
    a = arrivals(spark, d)
    one, two = (a.where(F.col("user_id") == u).select("topic", "k").distinct() for u in (1, 2))
    return one.exceptAll(two).withColumn("only", F.lit(1)).unionByName(two.exceptAll(one).withColumn("only", F.lit(2)))


def unindexed_antijoin(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(2).alias("version"))
    return fleet.unindexed(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), o.distinct(), "id", 2)


def latest_tag_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"), F.lit(1).alias("version"))
    new = c.where("id % 10 = 0").select("id", F.lit("vip").alias("tag"), F.lit(2).alias("version"))
    return fleet.upserted(c, new, ["id"], "version")


def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    new = e.where("user_id < 10 and value > 50").select("user_id", "event_id", (F.col("value") * 0).alias("value"))
    return fleet.replaced(e, new, "user_id", e.where("user_id < 10"))


def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics row of every (unit, topic) signal with two samples at least."""
    out = series.describe(arrivals(spark, d), ["user_id", "topic"]).where("n >= 2")
    return out.select("user_id", "topic", "n", R("min"), R("max"), R("mean"), R("std"), R("p50"), R("p95"), R("p99"))


def _history(spark, d):
    day = F.floor(F.col("t") / 86400.0)
    h = arrivals(spark, d).groupBy("user_id", day.alias("x")).agg(F.round(F.avg("v"), 4).alias("score"), F.count("*").alias("messages"))
    return h


def preflight(spark: SparkSession, d: str) -> DataFrame:
    return fleet.preflight(_history(spark, d), "user_id").select("user_id", "n", "last_score", "compromised", R("slope"), "decision")


def unit_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fleet.fingerprint(_history(spark, d), "user_id", ["score", "messages"]).select("user_id", "metric", R("slope"), R("weight", 4))


def precedents(spark: SparkSession, d: str) -> DataFrame:
    e = arrivals(spark, d).select(F.col("seq").alias("id"), F.col("topic").alias("kind"), "t")
    m = arrivals(spark, d).select(F.col("seq").alias("id"), F.col("user_id").alias("unit"))
    return fleet.precedents(e, m, "id", "unit", "error").select("id", "kind", R("t"), "unit")


def precedents_summary(spark: SparkSession, d: str) -> DataFrame:
    out = fleet.affected(precedents(spark, d), "unit")
    return out.select("occurrences", F.array_join(F.transform("units", lambda x: x.cast("string")), ",").alias("units"), "fleet_wide")


def rank_missions(spark: SparkSession, d: str) -> DataFrame:
    """The first five orders by each metric; lines stand for topics, and lines that were returned for events."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("health_score"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("duration_s"), (F.col("o_custkey") % 1000).alias("message_count"), (F.col("o_totalprice") * 100).cast("long").alias("size_bytes"))
    lines = table(spark, d, "lineitem")
    topics = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("gap_count"), F.col("l_quantity").alias("estimated_dropped"), F.col("l_discount").alias("jitter_cv"))
    events = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("severity"))
    out = [fleet.ranked(k, m, topics, events, "id", k == "duration_s", 5) for k in fleet.METRICS]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].select("metric", "rank", "id", F.round("value", 4).alias("value"))


def alignment_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first arrival by the clock, as a share of the recording and since the user's anchor."""
    a = arrivals(spark, d).select("user_id", F.col("topic").alias("signal"), "t", "v")
    moves = fleet.anchors(a, "user_id", ["purchase", "signup", "click"], 90.0)
    durations = a.groupBy("user_id").agg(F.max("t").alias("duration_s"))
    first = a.groupBy("user_id").agg(F.min("t").alias("t"))
    out = first.select("user_id", F.col("t").alias("absolute")).join(moves.select("user_id", F.col("t").alias("anchor"), "source"), "user_id", "left")
    for mode in ("progress", "event"):
        out = out.join(fleet.aligned(first, "user_id", mode, durations, moves).withColumnRenamed("t", mode), "user_id")
    return out.select("user_id", R("absolute"), R("anchor"), "source", R("progress"), R("event"))


def find_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five users most like user 1, by fingerprint and then by time warping."""
    bins = series.resample(arrivals(spark, d), ["user_id"], 43200.0).where("mean is not null").select("user_id", F.col("bin").alias("i"), F.col("mean").alias("v"))
    out = fleet.most_similar(_features(spark, d), "user_id", ["f1", "f2", "f3"], "topics", "templates", 1, bins)
    return out.select("user_id", R("similarity", 5), R("distance"), "why")


def false_alarms_per_clean(spark: SparkSession, d: str) -> DataFrame:
    """Long gaps of topics, taking recordings in which errors are few as clean."""
    a = arrivals(spark, d)
    clean = a.groupBy(*KEYS).agg(F.max("v").alias("m")).where("topic <> 'error'").select(F.concat_ws("/", *KEYS).alias("id"))
    found = _gaps(spark, d).where("duration_s > 5400").select(F.concat_ws("/", *KEYS).alias("id"))
    return gate.false_alarms(found, clean, "id").select("recordings", "alarms", R("per_recording", 4))


def _episodes(spark, d):
    """A unit's events as an episode.

    A score is the plain sum of values in order of seq over their number, so no layout of rows changes a bit of it.
    Verdicts go by the sum in decimals, so a mean that is the bound is not below it by rounding; where values do not
    fit decimals, by the score.
    """
    w = Window.partitionBy("user_id").orderBy("seq", "us", "v")
    a = arrivals(spark, d).withColumn("_i", F.row_number().over(w)).withColumn("_sum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    score = F.try_divide(F.max_by("_sum", "_i"), F.count("v"))
    exact = F.expr("try_cast(v AS DECIMAL(38, 18))")
    mean = F.when(F.count(exact) == F.count("v"), F.try_divide(F.try_sum(exact).cast("double"), F.count("v")))
    e = a.groupBy("user_id").agg((F.max("t") - F.min("t")).alias("t_end"), score.alias("score"), F.coalesce(mean, score).alias("mean"), F.array_sort(F.collect_set("topic")).alias("topics"), F.sum(F.when(F.col("topic") == "error", 1.0).otherwise(0.0)).alias("errors"), F.count("*").alias("n"))
    loss = F.col("errors") / F.col("n")
    verdict = F.when(F.col("n") < 50, "unassessable").when(F.col("mean") >= 50, "healthy").when(F.col("mean") >= 45, "degraded").otherwise("compromised")
    e = e.select("user_id", "t_end", "score", "topics", loss.alias("loss"), verdict.alias("verdict"), (F.col("errors") * 3600.0).alias("stalled_s"), F.lit(0.05).alias("lag_s"), F.lit(0.0).alias("longest_gap_s"), F.lit(0).alias("backward"), (F.col("user_id") % 50 == 0).alias("truncated"), F.lit(0.0).alias("corrupt_share"))
    return gate.decided(e, gate.Policy(loss=0.22, stall=0.03, topics=("signup",)))


def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).select("user_id", "verdict", "decision", F.array_join("reasons", ",").alias("reasons"))


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return gate.summary(_episodes(spark, d)).select("decision", "n", R("seconds", 4))


def gate_rejections(spark: SparkSession, d: str) -> DataFrame:
    return gate.rejections(_episodes(spark, d))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d)
    halves = lambda c: (F.round(F.col(c) * 1e4) / 1e4).alias(c)  # noqa: E731  halves of the last digit as SQL rounds them, by the product
    before = e.where("user_id % 2 = 0").select("user_id", (F.col("score") + F.col("user_id") % 9).alias("score"))
    return gate.against_baseline(e, before, "user_id", 40.0, 5.0).select("user_id", halves("score"), halves("before"), "passed")


def detector_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the detector against days with few arrivals of a topic, taken as truth."""
    a = arrivals(spark, d)
    days = a.groupBy(*KEYS, F.floor(F.col("t") / 86400.0).alias("id")).agg(F.count("*").alias("c")).where("c < 60")
    truth = days.select(*KEYS, "id", (F.col("id") * 86400.0).alias("lo"), ((F.col("id") + 1) * 86400.0).alias("hi"))
    found = _gaps(spark, d).where("duration_s > 5400").select(*KEYS, F.col("gap").alias("id"), F.col("t_start").alias("lo"), F.col("t_end").alias("hi"))
    return gate.matched(truth, found, list(KEYS), 60.0, 86400.0).select("tp", "fn", "fp", R("precision"), R("recall"), R("f1"))


def qos_rules(spark: SparkSession, d: str) -> DataFrame:
    """Delivery settings of each topic of each unit against its rate."""
    a = arrivals(spark, d).groupBy("user_id", "topic").agg((F.count("*") / 10.0).alias("hz"))
    q = a.select("user_id", "topic", "hz", F.when(F.col("user_id") % 2 == 0, "best_effort").otherwise("reliable").alias("reliability"), F.lit("keep_last").alias("history"), (F.col("user_id") % 11).cast("int").alias("depth"), F.when(F.col("user_id") % 3 == 0, "transient_local").otherwise("volatile").alias("durability"), F.when(F.col("user_id") % 5 == 0, 1.0).alias("deadline_s"), ((F.col("user_id") % 7) / 100.0).alias("drop_rate"))
    return qos.checked(q, least_hz=1.2).select("user_id", "topic", F.array_join("issues", ",").alias("issues"))


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to vector 0."""
    e = table(spark, d, "embeddings")
    goal = e.where("vec_id = 0").select(F.col("embedding").alias("g"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    c = dot(F.col("embedding"), F.col("g")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("g"), F.col("g")))
    out = e.where("vec_id <> 0").crossJoin(F.broadcast(goal))  # one row
    return out.select("vec_id", F.round(c, 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


def dtw_rank(spark: SparkSession, d: str) -> DataFrame:
    """Units' series of values by dynamic time warping from unit 1's."""
    bins = series.resample(arrivals(spark, d), ["user_id"], 43200.0).where("mean is not null")
    return dtw_rank_op(bins.select("user_id", F.col("bin").alias("i"), F.col("mean").alias("v")), "user_id", 1).select("user_id", R("distance"))


def stalls_joined(spark: SparkSession, d: str) -> DataFrame:
    """Interval join: arrivals inside system-wide stalls, counted by topic."""
    s = _stalls(spark, d).select("mission_id", "stall", F.col("t_start").alias("rs"), F.col("t_end").alias("re"))
    a = arrivals(spark, d).select(*KEYS, "seq", F.col("t").alias("ls"), F.col("t").alias("le"))
    from tidemark.operators.intervals import overlapping

    return overlapping(a, s, ["mission_id"], 3600.0, strict=False).groupBy(*KEYS).agg(F.countDistinct("seq").alias("n"))


def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of events by hash of what they are, in three ways, and as a page token would carry them."""
    e = table(spark, d, "events")
    what = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.select("event_id", F.md5(what.cast("binary")).alias("md5"), F.sha1(what.cast("binary")).alias("sha1"), F.substring(F.sha2(what.cast("binary"), 256), 1, 24).alias("short"), F.base64(what.cast("binary")).alias("token"))


def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    """A star join: customers, nations and regions."""
    c, n, g = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    out = c.join(o, c.c_custkey == o.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return out.groupBy("r_name", "n_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("value"))


QUERIES = {f.__name__: f for f in (fleet_summary, group_counts, missions_filtered_page, mission_search, cohort_compare, cohort_before_after, rank_metric, regression_scan, mission_similarity, signal_diff, topic_set_diff, unindexed_antijoin, latest_tag_upsert, replace_rows, signal_stats, preflight, unit_fingerprint, precedents, precedents_summary, rank_missions, alignment_modes, find_similar, false_alarms_per_clean, gate_decisions, gate_summary, gate_rejections, quality_gate, detector_precision_recall, qos_rules, vector_topk_cosine, dtw_rank, stalls_joined, finding_ids, nation_orders)}

STEPS |= {
    "mi": "SELECT o_orderkey AS id, o_custkey AS unit, o_orderstatus AS verdict, o_totalprice AS value, o_orderdate AS day, o_orderpriority AS tag FROM orders",
    "mo": "SELECT verdict, (year(day) * 12 + month(day))::DOUBLE AS x, round(avg(value), 4) AS y FROM mi GROUP BY ALL",
    "ft": "SELECT user_id, ln(1 + count(*)::DOUBLE) AS f1, avg(v) AS f2, ln(1 + max(t) - min(t)) AS f3, list_sort(list(DISTINCT topic)) AS topics, list_sort(list(DISTINCT k)) AS templates FROM a GROUP BY ALL",
    "fz": "SELECT user_id, topics, templates, " + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in ("f1", "f2", "f3")) + " FROM ft",
    "ab": "SELECT topic, v, CASE WHEN user_id = 1 THEN 'a' ELSE 'b' END AS side FROM a WHERE user_id IN (1, 2)",
    "hs": "SELECT user_id, floor(t / 86400.0)::BIGINT AS x, round(avg(v), 4) AS score, count(*) AS messages FROM a GROUP BY ALL",
    "hl": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC) AS q FROM hs) WHERE q <= 5",
    "hm": "SELECT user_id, 'score' AS metric, x, score AS y FROM hs UNION ALL SELECT user_id, 'messages', x, messages::DOUBLE FROM hs",
    "ep0": "SELECT user_id, max(t) - min(t) AS t_end, avg(v) AS score, list(DISTINCT topic) AS topics, sum((topic = 'error')::INT)::DOUBLE AS errors, count(*) AS n FROM a GROUP BY ALL",
    "ep1": "SELECT *, errors / n AS loss, errors * 3600.0::DOUBLE AS stalled_s, CASE WHEN n < 50 THEN 'unassessable' WHEN score >= 50 THEN 'healthy' WHEN score >= 45 THEN 'degraded' ELSE 'compromised' END AS verdict FROM ep0",
    "ep2": "SELECT *, concat_ws(',', CASE WHEN verdict = 'unassessable' THEN 'unassessable' END, CASE WHEN t_end < 1 THEN 'too_short' END, CASE WHEN user_id % 50 = 0 THEN 'truncated' END, CASE WHEN NOT list_contains(topics, 'signup') THEN 'missing_topic:signup' END, CASE WHEN stalled_s / t_end > 0.03 THEN 'recorder_stall' END, CASE WHEN loss > 0.22 THEN 'message_loss' END, CASE WHEN verdict = 'compromised' THEN 'compromised' END) AS reasons FROM ep1",
    "ep": "SELECT *, CASE WHEN reasons = '' THEN 'accept' WHEN reasons = 'compromised' THEN 'review' ELSE 'reject' END AS decision FROM ep2",
    "tru": f"SELECT {K}, floor(t / 86400.0)::BIGINT AS id FROM a GROUP BY ALL HAVING count(*) < 60",
    "fnd": f"SELECT {K}, gap, t_start, t_end FROM gaps WHERE duration_s > 5400",
    "hit": "SELECT t.mission_id, t.topic, t.id, f.gap FROM tru t JOIN fnd f ON t.mission_id = f.mission_id AND t.topic = f.topic AND t.id * 86400.0::DOUBLE - 60.0 <= f.t_end AND f.t_start <= (t.id + 1) * 86400.0::DOUBLE + 60.0",
    "prf": f"SELECT (SELECT count(DISTINCT (mission_id, topic, id)) FROM hit) AS tp, (SELECT count(*) FROM tru) - (SELECT count(DISTINCT (mission_id, topic, id)) FROM hit) AS fn, (SELECT count(*) FROM fnd) - (SELECT count(DISTINCT (mission_id, topic, gap)) FROM hit) AS fp",
    "prr": "SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision FROM prf",
}


def _trend(rows: str, keys: str) -> str:
    """(keys, n, slope, tau, mad) of rows(keys, x, y)."""
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""SELECT *, CASE WHEN n >= 4 AND dd > 0 THEN ss / dd ELSE 0 END AS tau FROM (SELECT {pk}, quantile_cont((q.y - p.y) / (q.x - p.x), 0.5) AS slope, sum(sign(q.y - p.y)) AS ss, sum(abs(sign(q.y - p.y))) AS dd FROM {rows} p JOIN {rows} q ON {on} AND p.x < q.x GROUP BY ALL) JOIN (SELECT {keys}, count(*) AS n, mad(y) AS mad FROM {rows} GROUP BY ALL) USING ({keys})"""


_SIG = "n >= 4 AND abs(tau) / sqrt(2.0::DOUBLE * (2 * n + 5) / (9.0::DOUBLE * n * (n - 1))) > 1.959963984540054::DOUBLE"
_D = "CASE WHEN n_a >= 2 AND n_b >= 2 AND ((n_a - 1) * va + (n_b - 1) * vb) > 0 THEN (mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) ELSE 0 END"
_MAG = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude"
_AB = "count(v) FILTER (side = 'a') AS n_a, count(v) FILTER (side = 'b') AS n_b, avg(v) FILTER (side = 'a') AS mean_a, avg(v) FILTER (side = 'b') AS mean_b, var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb"

SQL = {
    "fleet_summary": chain("SELECT count(*) AS missions, count(DISTINCT unit) AS units, round(coalesce(sum(value), 0), 2) AS total, round(avg(value), 4) AS mean FROM mi", "mi"),
    "group_counts": chain("SELECT verdict, tag, count(*) AS n, round(avg(value), 4) AS mean FROM mi GROUP BY ALL", "mi"),
    "missions_filtered_page": chain("SELECT id, unit, value FROM mi WHERE verdict = 'F' AND value >= 1000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_quantity >= 45) ORDER BY day DESC NULLS LAST, id LIMIT 50 OFFSET 20", "mi"),
    "mission_search": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '1') OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND contains(lower(n_name), '1'))",
    "cohort_compare": chain("SELECT tag, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median FROM mi GROUP BY ALL", "mi"),
    "cohort_before_after": chain(f"SELECT verdict, n_a, n_b, {r('mean_a', 4)}, {r('mean_b', 4)}, {r('d')}, {_MAG} FROM (SELECT *, {_D} AS d FROM (SELECT verdict, {_AB} FROM (SELECT verdict, value AS v, CASE WHEN day < TIMESTAMP '1995-06-01' THEN 'a' ELSE 'b' END AS side FROM mi) GROUP BY ALL))", "mi"),
    "rank_metric": chain("SELECT id, coalesce(lines, 0) AS lines, value FROM mi LEFT JOIN (SELECT l_orderkey AS id, count(*) AS lines FROM lineitem GROUP BY ALL) USING (id) ORDER BY lines DESC, value DESC, id LIMIT 25", "mi"),
    "regression_scan": chain(f"SELECT verdict, n, {r('slope', 4)}, {r('tau')}, {_SIG} AS significant, {r('mad', 4)}, CASE WHEN n < 3 OR abs(slope) * (n - 1) <= mad THEN 'steady' WHEN slope > 0 THEN 'improving' ELSE 'worsening' END AS trend FROM ({_trend('mo', 'verdict')})", "mo"),
    "mission_similarity": chain("SELECT z.user_id, round(0.5::DOUBLE * exp(-sqrt(pow(z.f1 - g.f1, 2) + pow(z.f2 - g.f2, 2) + pow(z.f3 - g.f3, 2)) / sqrt(3.0)) + 0.3::DOUBLE * len(list_intersect(z.topics, g.topics)) / len(list_distinct(list_concat(z.topics, g.topics))) + 0.2::DOUBLE * len(list_intersect(z.templates, g.templates)) / len(list_distinct(list_concat(z.templates, g.templates))), 5) AS similarity FROM fz z JOIN fz g ON g.user_id = 1 WHERE z.user_id <> 1", "fz"),
    "signal_diff": chain(f"SELECT topic, {r('mean_a')}, {r('mean_b')}, round(CASE WHEN mean_a <> 0 THEN (mean_b - mean_a) / mean_a * 100 ELSE 0 END, 4) AS percent, {r('d', 5)}, {r('ks')}, {_MAG} FROM (SELECT *, {_D} AS d FROM (SELECT topic, {_AB} FROM ab GROUP BY ALL)) JOIN (SELECT topic, max(g) AS ks FROM (SELECT topic, abs(sum(na) OVER o / sum(na) OVER w - sum(nb) OVER o / sum(nb) OVER w) AS g FROM (SELECT topic, v, sum((side = 'a')::INT) AS na, sum((side = 'b')::INT) AS nb FROM ab GROUP BY ALL) WINDOW o AS (PARTITION BY topic ORDER BY v), w AS (PARTITION BY topic)) GROUP BY ALL) USING (topic) WHERE n_a > 0 AND n_b > 0", "ab"),
    "topic_set_diff": chain("SELECT topic, k, 1 AS only FROM (SELECT topic, k FROM a WHERE user_id = 1 EXCEPT SELECT topic, k FROM a WHERE user_id = 2) UNION ALL SELECT topic, k, 2 FROM (SELECT topic, k FROM a WHERE user_id = 2 EXCEPT SELECT topic, k FROM a WHERE user_id = 1)", "a"),
    "unindexed_antijoin": "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "latest_tag_upsert": "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'vip' ELSE c_mktsegment END AS tag, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM customer",
    "replace_rows": "SELECT user_id, event_id, CASE WHEN user_id < 10 THEN 0 ELSE value END AS value FROM events WHERE user_id >= 10 OR value > 50",
    "signal_stats": chain(f"SELECT user_id, topic, n, {r('min')}, {r('max')}, {r('mean')}, {r('std')}, {r('p50')}, {r('p95')}, {r('p99')} FROM (SELECT user_id, topic, count(v) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM a GROUP BY ALL) WHERE n >= 2", "a"),
    "preflight": chain("SELECT user_id, n, last_score, compromised, round(slope, 6) AS slope, CASE WHEN last_score < 60 OR compromised >= 2 THEN 'block' WHEN last_score < 85 OR coalesce(slope, 0) < -2 OR n < 3 THEN 'warn' ELSE 'go' END AS decision FROM (SELECT user_id, count(*) AS n, arg_max(score, x) AS last_score, sum((score < 60)::INT)::BIGINT AS compromised FROM hl GROUP BY ALL) LEFT JOIN (SELECT p.user_id, quantile_cont((q.score - p.score) / (q.x - p.x), 0.5) AS slope FROM hl p JOIN hl q ON p.user_id = q.user_id AND p.x < q.x GROUP BY ALL) USING (user_id)", "hl"),
    "unit_fingerprint": chain(f"SELECT user_id, metric, {r('slope')}, round(abs(slope) / greatest(mad, 1e-9), 4) AS weight FROM ({_trend('hm', 'user_id, metric')}) WHERE n >= 3 AND abs(slope) * (n - 1) > mad AND slope <= 0", "hm"),
    "precedents": chain("SELECT seq AS id, topic AS kind, round(t, 6) AS t, user_id AS unit FROM a WHERE topic = 'error' ORDER BY a.t DESC, seq LIMIT 20", "a"),
    "precedents_summary": chain("SELECT count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, count(DISTINCT unit) > 1 AS fleet_wide FROM (SELECT user_id AS unit FROM a WHERE topic = 'error' ORDER BY a.t DESC, seq LIMIT 20)", "a"),
    "rank_missions": " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS metric, row_number() OVER (ORDER BY {v} {o}, o_orderkey)::INT AS rank, o_orderkey AS id, round(({v})::DOUBLE, 4) AS value FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_linenumber) AS g, sum(l_quantity) AS q, max(l_discount) AS j, count(*) FILTER (l_returnflag = 'R') AS e, count(*) FILTER (l_returnflag = 'R' AND l_linenumber >= 4) AS x FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey) WHERE rank <= 5" for k, v, o in (("health_score", "o_totalprice", "DESC"), ("duration_s", "epoch_us(o_orderdate)", "ASC"), ("message_count", "o_custkey % 1000", "DESC"), ("size_bytes", "trunc(o_totalprice * 100)", "DESC"), ("gap_count", "coalesce(g, 0)", "DESC"), ("estimated_dropped", "coalesce(q, 0)", "DESC"), ("max_jitter_cv", "coalesce(j, 0)", "DESC"), ("event_count", "coalesce(e, 0)", "DESC"), ("critical_events", "coalesce(x, 0)", "DESC"))),
    "alignment_modes": chain("SELECT user_id, round(t0, 6) AS absolute, round(m, 6) AS anchor, source, round(t0 / greatest(t1, 1e-9), 6) AS progress, round(t0 - coalesce(m, 0), 6) AS event FROM (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY ALL) LEFT JOIN (SELECT user_id, arg_min(t, p) AS m, arg_min(topic, p) AS source FROM (SELECT user_id, topic, min(t) AS t, list_position(['purchase', 'signup', 'click'], topic) AS p FROM a WHERE topic IN ('purchase', 'signup', 'click') AND abs(v) > 90 GROUP BY ALL) GROUP BY ALL) USING (user_id)", "a"),
    "false_alarms_per_clean": chain(f"SELECT count(*) AS recordings, coalesce(sum(n), 0)::BIGINT AS alarms, round(coalesce(sum(n), 0) / count(*), 4) AS per_recording FROM (SELECT DISTINCT {K} FROM a WHERE topic <> 'error') LEFT JOIN (SELECT {K}, count(*) AS n FROM gaps WHERE duration_s > 5400 GROUP BY ALL) USING ({K})", "gaps"),
    "gate_decisions": chain("SELECT user_id, verdict, decision, reasons FROM ep", "ep"),
    "gate_summary": chain("SELECT decision, count(*) AS n, round(sum(t_end), 4) AS seconds FROM ep GROUP BY ALL", "ep"),
    "gate_rejections": chain("SELECT code, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS code FROM ep WHERE reasons <> '') GROUP BY ALL", "ep"),
    "quality_gate": chain("SELECT user_id, round(score, 4) AS score, round(before, 4) AS before, verdict IN ('healthy', 'degraded') AND score >= 40 AND (before IS NULL OR before - score <= 5) AS passed FROM (SELECT user_id, verdict, score, CASE WHEN user_id % 2 = 0 THEN score + user_id % 9 END AS before FROM ep)", "ep"),
    "detector_precision_recall": chain("SELECT tp, fn, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM prr", "prr"),
    "qos_rules": chain("SELECT user_id, topic, concat_ws(',', CASE WHEN user_id % 2 = 0 THEN CASE WHEN (user_id % 7) / 100.0 > 0.02 THEN 'best_effort:high' ELSE 'best_effort' END END, CASE WHEN user_id % 11 BETWEEN 1 AND 5 AND hz >= 1.2 THEN 'shallow_queue' END, CASE WHEN user_id % 5 = 0 AND (1.0 * hz < 1.0 / 3 OR 1.0 * hz > 3) THEN 'deadline_mismatch' END, CASE WHEN user_id % 3 = 0 AND hz >= 1.2 THEN 'transient_local_stream' END) AS issues FROM (SELECT user_id, topic, count(*) / 10.0::DOUBLE AS hz FROM a GROUP BY ALL)", "a"),
    "vector_topk_cosine": "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], g.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])), 5) AS cosine FROM embeddings e JOIN embeddings g ON g.vec_id = 0 WHERE e.vec_id <> 0 ORDER BY cosine DESC, e.vec_id LIMIT 10",
    "stalls_joined": chain("SELECT a.mission_id, a.topic, count(DISTINCT seq) AS n FROM a JOIN stalls s ON s.mission_id = a.mission_id AND a.t BETWEEN s.t_start AND s.t_end GROUP BY ALL", "stalls"),
    "finding_ids": "SELECT event_id, md5(w) AS md5, sha1(w) AS sha1, substr(sha256(w), 1, 24) AS short, to_base64(encode(w)) AS token FROM (SELECT event_id, concat_ws('|', event_type, user_id, event_id) AS w FROM events)",
    "nation_orders": "SELECT r_name, n_name, coalesce(sum(n), 0)::BIGINT AS orders, round(coalesce(sum(v), 0), 2) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL) ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}
