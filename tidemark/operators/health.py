"""Stalls across topics, density, scores, assessability and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.operators.intervals import islands, overlapping, shared_seconds
from tidemark.sources.events import KEYS


def last_before(asked: DataFrame, arrivals: DataFrame) -> DataFrame:
    """asked(mission_id, other, le, ...) with last_seen, the last arrival of the topic other at le or before.

    Rows and arrivals of a topic go through one window in order of time.
    """
    w = Window.partitionBy("mission_id", "other").orderBy("le", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = arrivals.select("mission_id", F.col("topic").alias("other"), F.col("t").alias("le"), F.lit(0).alias("_side"), F.col("t").alias("_at"))
    both = asked.withColumn("_side", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    return both.withColumn("last_seen", F.last("_at", True).over(w)).where("_side = 1").drop("_side", "_at")


def concurrency(found: DataFrame, topics: DataFrame, arrivals: DataFrame, c: Config = ROBOT, cell: float = 3600.0) -> DataFrame:
    """Each silent interval with the share of other topics that were silent with it.

    found(keys, gap, t_start, t_end); topics(keys, first_t, nominal, assessable), one row for each topic that has
    messages. Topics without a rate open no interval and have no vote. A topic counts if it was there before the interval
    began and would have published within it; it is silent with it if its own intervals that have ended by then overlap
    enough of it, or it has no message in it. The topics that count stand for all of the recording: where some start later, the share is of the
    same part of those.
    """
    found = found.join(topics.where("assessable").select(*KEYS), list(KEYS), "left_semi")
    own = found.select(*KEYS, "gap", F.col("t_start").alias("ls"), F.col("t_end").alias("le"))
    others = found.select("mission_id", F.col("topic").alias("other"), F.col("t_start").alias("rs"), F.col("t_end").alias("re"))
    shared = overlapping(own, others, ["mission_id"], cell).where("topic <> other and re <= le")
    shared = shared.groupBy(*KEYS, "gap", "other").agg(F.sum(shared_seconds()).alias("s"))
    peers = topics.select("mission_id", F.col("topic").alias("other"), F.col("first_t").alias("from_t"), "nominal", "assessable")
    before = own.join(peers, "mission_id").where((F.col("topic") != F.col("other")) & (F.col("from_t") <= F.col("ls")))
    due = F.col("assessable") & (F.col("nominal") > 0) & (F.col("nominal") < F.col("le") - F.col("ls"))
    asked = last_before(before.withColumn("due", F.coalesce(due, F.lit(False))), arrivals)
    hit = asked.join(shared, [*KEYS, "gap", "other"], "left")
    silent = F.col("due") & ((F.coalesce("s", F.lit(0.0)) >= c.overlap * (F.col("le") - F.col("ls"))) | (F.col("last_seen") <= F.col("ls")))
    counts = hit.groupBy(*KEYS, "gap").agg(F.count("*").alias("there"), F.sum(F.col("due").cast("long")).alias("eligible"), F.sum(silent.cast("long")).alias("co_silent"), F.array_sort(F.collect_set(F.when(silent, F.col("other")))).alias("co"))
    expected = topics.groupBy("mission_id").agg(F.count("*").alias("expected"))
    out = found.join(counts, [*KEYS, "gap"], "left").join(expected, "mission_id").fillna(0, ["there", "eligible", "co_silent"])
    of = F.greatest(F.col("eligible").cast("double"), (F.col("expected") - 1) * F.col("eligible") / F.col("there"))
    out = out.withColumn("concurrency", F.when(F.col("eligible") > 0, F.col("co_silent") / of).otherwise(0.0))
    kind = F.when(F.col("concurrency") > c.system_wide, "system_wide").when(F.col("concurrency") < c.isolated, "isolated").otherwise("subsystem")
    co = F.coalesce("co", F.array().cast("array<string>"))
    return out.withColumn("class", kind).withColumn("co", co).withColumn("co_topics", F.array_join(co, ",")).drop("there", "expected")


def _wide(classed: DataFrame, ends: DataFrame, c: Config) -> DataFrame:
    """System-wide intervals, and whether each is too long for a stall of its recording."""
    span = classed.groupBy("mission_id").agg((F.max("t_end") - F.min("t_start")).alias("_h"))
    rows = classed.where("class = 'system_wide'").join(span, "mission_id").join(ends.select("mission_id", F.col("t_end").alias("_e")), "mission_id")
    return rows.withColumn("implausible", F.col("t_end") - F.col("t_start") > c.stall_fraction * F.greatest("_h", "_e")).drop("_h", "_e")


def implausible(classed: DataFrame, ends: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(mission_id, rejected): system-wide intervals that are too long to be stalls."""
    return _wide(classed, ends, c).where("implausible").groupBy("mission_id").agg(F.count("*").alias("rejected"))


def stalls(classed: DataFrame, ends: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(mission_id, stall, t_start, t_end, pieces, concurrency, topics): system-wide intervals merged.

    topics are all that were silent in one of them; concurrency is that of the first. Implausibly long ones are left out.
    """
    out = islands(_wide(classed, ends, c).where("not implausible"), ["mission_id"], "t_start", "t_end", c.stall_slack, "topic").groupBy("mission_id", "island")
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union("co", F.array("topic"))))))
    first = F.min_by("concurrency", F.struct("t_start", "t_end", "topic"))
    return out.agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("pieces"), first.alias("concurrency"), topics.alias("topics")).withColumnRenamed("island", "stall")


def stalled_seconds(found: DataFrame, stalls_: DataFrame, cell: float = 3600.0) -> DataFrame:
    """(keys, stall_s): how much of each topic's gaps lies in stalls."""
    left = found.select(*KEYS, F.col("t_start").alias("ls"), F.col("t_end").alias("le"))
    right = stalls_.select("mission_id", F.col("t_start").alias("rs"), F.col("t_end").alias("re"))
    return overlapping(left, right, ["mission_id"], cell).groupBy(*KEYS).agg(F.sum(shared_seconds()).alias("stall_s"))


def rolled_up(found: DataFrame, stalls_: DataFrame, share: float = 0.8, cell: float = 3600.0) -> DataFrame:
    """Gaps with the first stall that holds so much of them, or null."""
    left = found.select(*KEYS, "gap", F.col("t_start").alias("ls"), F.col("t_end").alias("le"))
    right = stalls_.select("mission_id", "stall", F.col("t_start").alias("rs"), F.col("t_end").alias("re"))
    held = overlapping(left, right, ["mission_id"], cell).where(shared_seconds() >= share * (F.col("le") - F.col("ls")))
    first = held.groupBy(*KEYS, "gap").agg(F.min("stall").alias("stall"))
    return found.join(first, [*KEYS, "gap"], "left")


def nearest(found: DataFrame, others: DataFrame) -> DataFrame:
    """Each gap(keys, gap, t_start) with the interval(keys, at, id) whose start is nearest; the earlier one of equals."""
    w = Window.partitionBy(*KEYS).orderBy("x", "side")
    a = found.select(*KEYS, F.col("t_start").alias("x"), F.lit(1).alias("side"), "gap", F.lit(None).cast("double").alias("at"))
    b = others.select(*KEYS, F.col("at").alias("x"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("gap"), "at")
    both = a.unionByName(b).withColumn("before", F.last("at", True).over(w)).withColumn("after", F.first("at", True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("side = 1")
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (F.col("x") - F.col("before") <= F.col("after") - F.col("x")), F.col("before")).otherwise(F.col("after"))
    return both.select(*KEYS, "gap", F.col("x").alias("t_start"), pick.alias("nearest_start"))


def unassessable_so_far(timed: DataFrame, c: Config = ROBOT) -> DataFrame:
    """Rows (dt > 0, with n, t, first_t, warm_n and period) with blind: whether the topic has no usable rate yet."""
    span = F.col("t") - F.col("first_t")
    known = F.when(F.col("n") >= F.col("warm_n"), F.col("period"))
    blind = known.isNull() | (F.col("n") < 2) | (span <= 0) | (1 / known > c.aperiodic_ratio * F.col("n") / span)
    return timed.withColumn("blind", F.coalesce(blind, F.lit(True)))


def timeline(arrivals: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, width_s, column, n): counts in columns whose width doubles until the recording fits."""
    end = arrivals.groupBy("mission_id").agg(F.max("t").alias("_e"))
    k = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_e") + 1e-9) / (c.column_s * c.columns))))
    width = c.column_s * F.pow(F.lit(2.0), k)
    end = end.withColumn("width_s", F.when(F.floor(F.col("_e") / width) < c.columns, width).otherwise(2 * width)).drop("_e")
    return arrivals.join(end, "mission_id").groupBy(*KEYS, "width_s", F.floor(F.greatest(F.col("t"), F.lit(0.0)) / F.col("width_s")).alias("column")).agg(F.count("*").alias("n"))


def coverage(columns: DataFrame, ends: DataFrame) -> DataFrame:
    """(mission_id, covered, columns, coverage): the share of a recording's columns with a message of these topics."""
    out = columns.groupBy("mission_id").agg(F.countDistinct("column").alias("covered"), F.max("width_s").alias("_w")).join(ends, "mission_id")
    out = out.withColumn("columns", F.floor(F.col("t_end") / F.col("_w")) + 1).drop("_w", "t_end")
    return out.withColumn("coverage", F.col("covered") / F.col("columns"))


def topic_score(gap_share: Column, drop: Column, cv: Column, drift: Column) -> Column:
    """0 to 100 from four penalties, each at most 1."""
    jitter = F.when(cv > 0.2, (cv - 0.2) / 0.8).otherwise(0.0)
    cap = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.greatest(F.lit(0.0), 100 * (1 - 0.30 * cap(gap_share) - 0.35 * cap(drop) - 0.20 * cap(jitter) - 0.15 * cap(drift)))


def status(period: Column, sustained_hz: Column, c: Config = ROBOT) -> Column:
    """sparse without a learned period, aperiodic if it promises far more than was sustained, else assessed."""
    return F.when(period.isNull(), "sparse").when(1 / period > c.aperiodic_ratio * sustained_hz, "aperiodic").otherwise("assessed")


def topic_health(rates: DataFrame, periods: DataFrame, found: DataFrame, drops: DataFrame, ends: DataFrame, cvs: DataFrame, drifts: DataFrame, stalled: DataFrame, c: Config = ROBOT) -> DataFrame:
    """One row for each topic: status assessed, sparse or aperiodic, rates, silence and score.

    cvs(keys, cv) has the last jitter of each topic, drifts(keys, drift) the largest relative slope of its episodes,
    stalled(keys, stall_s) its silence within stalls, which the recording answers for and the topic does not.
    """
    silent = found.groupBy(*KEYS).agg(F.count("*").alias("n_gaps"), F.sum("silent_s").alias("silent_s"), F.max("duration_s").alias("longest_gap_s"))
    out = rates.join(periods, list(KEYS), "left")
    for part in (silent, drops.select(*KEYS, "dropped", "rate"), cvs, drifts, stalled):
        out = out.join(part, list(KEYS), "left")
    out = out.join(ends, "mission_id").fillna(0, ["n_gaps", "silent_s", "longest_gap_s", "dropped", "rate", "cv", "drift", "stall_s"]).withColumn("expected_hz", 1 / F.col("period"))
    out = out.withColumn("status", status(F.col("period"), F.col("sustained_hz"), c))
    active = F.greatest(F.lit(1e-9), F.col("t_end") - F.col("first_t") - F.col("silent_s"))
    out = out.withColumn("observed_hz", F.col("n") / active).withColumn("dropped", F.when(F.col("status") == "assessed", F.col("dropped")).otherwise(0))
    share = F.greatest(F.lit(0.0), F.col("silent_s") - F.col("stall_s")) / F.greatest(F.lit(5.0), 0.05 * F.col("t_end"))
    lost = F.col("dropped") / F.greatest(F.col("n") + F.col("dropped"), F.lit(1))
    return out.withColumn("score", F.when(F.col("status") == "assessed", F.round(topic_score(share, lost, F.col("cv"), F.col("drift")), 1)).otherwise(100.0))


def verdict(health: DataFrame, covered: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each recording: assessability, overall score and verdict.

    covered are the columns of the assessed topics; files(mission_id, file_score) has scores of files, 100 where there
    is none. Too little that can be measured overrides the score, and a file's score caps the verdict. Stalls count once,
    by the topic that lost most to them.
    """
    ok = F.col("status") == "assessed"
    one = health.groupBy("mission_id").agg(F.count("*").alias("topics"), F.sum(ok.cast("long")).alias("assessed"), F.sum("n").alias("messages"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("assessed_messages"), F.coalesce(F.min(F.when(ok, F.col("score"))), F.min("score")).alias("worst"), F.coalesce(F.avg(F.when(ok, F.col("score"))), F.avg("score")).alias("mean"), F.max("t_end").alias("t_end"), F.max("stall_s").alias("stalled_s"))
    one = one.join(covered.select("mission_id", "coverage"), "mission_id", "left").fillna(0, ["coverage"])
    one = one.join(files.select("mission_id", "file_score"), "mission_id", "left").fillna(100, ["file_score"]) if files is not None else one.withColumn("file_score", F.lit(100.0))
    parts = [F.col("assessed") / F.col("topics") / 0.25, F.col("assessed_messages") / F.col("messages") / 0.5, F.col("coverage") / 0.5, F.col("t_end") / 20.0]
    one = one.withColumn("confidence", F.round(F.least(F.lit(1.0), *parts), 3)).withColumn("assessable", F.least(*parts) >= 1)
    fraction = F.when(F.col("t_end") > 0, F.least(F.lit(1.0), F.col("stalled_s") / F.col("t_end"))).otherwise(0.0)
    score = F.greatest(F.lit(0.0), (0.5 * F.col("worst") + 0.3 * F.col("mean") + 0.2 * F.col("file_score")) * (1 - 2.5 * fraction))
    one = one.withColumn("score", score)
    named = F.when(~F.col("assessable"), "unassessable").when(F.least("score", "file_score") >= 85, "healthy").when(F.least("score", "file_score") >= 60, "degraded").otherwise("compromised")
    return one.withColumn("verdict", named)
