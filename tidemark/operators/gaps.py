"""Gaps, jitter episodes and dropped messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.operators.cadence import per_topic
from tidemark.sources.events import KEYS

LEVELS = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def severity(duration: Column, periods: Column) -> Column:
    return F.when((duration >= 30) | (periods >= 1000), 4).when(periods >= 100, 3).when(periods >= 20, 2).otherwise(1)


def candidates(timed: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, seq, us, t_start, t_end, dt, period) of arrivals later than k periods and the floor."""
    late = timed.where(F.col("dt") > F.greatest(c.gap_k * F.col("period"), F.lit(c.gap_floor)))
    return late.select(*KEYS, "seq", "us", (F.col("t") - F.col("dt")).alias("t_start"), F.col("t").alias("t_end"), "dt", "period")


def gaps(found: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, t_start, t_end, pieces, silent_s, period, duration_s, periods, severity, lost): candidates merged."""
    w = per_topic()
    new = F.coalesce((F.col("t_start") - F.lag("t_end").over(w) > c.merge_periods * F.col("period")).cast("int"), F.lit(1))
    numbered = found.withColumn("_new", new).withColumn("gap", F.sum("_new").over(w))
    out = numbered.groupBy(*KEYS, "gap").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("pieces"), F.sum("dt").alias("silent_s"), F.min_by("period", "us").alias("period"))
    out = out.withColumn("duration_s", F.col("t_end") - F.col("t_start")).withColumn("periods", F.col("duration_s") / F.col("period"))
    out = out.withColumn("severity", severity(F.col("duration_s"), F.col("periods")))
    return out.withColumn("lost", F.greatest(F.lit(0), F.bround("periods", 0).cast("long") - 1)).withColumn("confidence", F.least(F.lit(1.0), 0.5 + F.col("periods") / (4 * c.gap_k)))


def longest(found: DataFrame, n: int) -> DataFrame:
    """The n longest gaps of each topic, and how many more it has."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("duration_s"), "t_start"))
    size = F.count("*").over(Window.partitionBy(*KEYS))
    return found.withColumn("rank", rank).withColumn("evicted", F.greatest(F.lit(0), size - n)).where(F.col("rank") <= n)


def jitter_cv(timed: DataFrame, c: Config = ROBOT) -> DataFrame:
    """Arrivals with dt of five periods at most, and cv of the last window of them with its size.

    Sums run over the whole topic and those before the window are taken off, so a row costs the same for any window;
    values count from the topic's first one, which keeps the differences exact enough.
    """
    ok = timed.where(F.col("period").isNull() | (F.col("dt") <= 5 * F.col("period")))
    w = per_topic()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = ok.withColumn("_x", F.col("dt") - F.first("dt").over(run)).withColumn("_i", F.row_number().over(w).cast("long"))
    ok = ok.withColumn("_s", F.sum("_x").over(run)).withColumn("_q", F.sum(F.col("_x") * F.col("_x")).over(run))
    ok = ok.withColumn("win_n", F.least(F.col("_i"), F.lit(c.jitter_window).cast("long")))
    for name in ("_s", "_q"):
        ok = ok.withColumn(name, F.col(name) - F.coalesce(F.lag(name, c.jitter_window).over(w), F.lit(0.0)))
    part = F.col("_s") / F.col("win_n")
    mean, var = F.col("dt") - F.col("_x") + part, F.greatest(F.lit(0.0), (F.col("_q") - F.col("win_n") * part * part) / (F.col("win_n") - 1))
    return ok.withColumn("cv", F.when((F.col("win_n") > 1) & (mean > 0), F.sqrt(var) / mean).otherwise(0.0)).drop("_x", "_i", "_s", "_q")


def jitter_episodes(cvs: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, t_start, t_end, peak, threshold) of runs above the threshold that last long enough."""
    base = cvs.where("n >= warm_n and win_n >= 10").groupBy(*KEYS).agg(F.min_by("cv", "n").alias("baseline"))
    rows = cvs.where(F.col("win_n") >= c.jitter_least).join(base, list(KEYS)).where("n >= warm_n")
    w = per_topic()
    rows = rows.withColumn("threshold", F.greatest(c.jitter_mult * F.col("baseline"), F.lit(c.jitter_floor)))
    rows = rows.withColumn("high", (F.col("cv") > F.col("threshold")).cast("int")).withColumn("next_t", F.coalesce(F.lead("t").over(w), F.col("t")))
    rows = rows.withColumn("run", F.sum(F.when(F.col("high") != F.lag("high", 1, 0).over(w), 1).otherwise(0)).over(w))
    out = rows.where("high = 1").groupBy(*KEYS, "run").agg(F.min("t").alias("t_start"), F.max("next_t").alias("t_end"), F.max("cv").alias("peak"), F.min("threshold").alias("threshold"))
    return out.where(F.col("t_end") - F.col("t_start") >= c.jitter_sustain).withColumn("severity", F.when(F.col("peak") > 3 * F.col("threshold"), 3).otherwise(2)).drop("run")


def dropped(rates: DataFrame, periods: DataFrame, found: DataFrame, ends: DataFrame, stalled: DataFrame) -> DataFrame:
    """(keys, expected_hz, count_based, gap_based, dropped, rate, agreement, severity): messages that a topic misses.

    What its period leaves missing outside critical gaps or stalls, whichever are longer, or what its other gaps have
    lost beyond the stalls' share; the larger one, if it is over the noise of the period. ends(mission_id, t_end)
    closes each recording; stalled(keys, stall_s) has the silent seconds within stalls.
    """
    hz = 1 / F.col("period")
    by_gap = found.join(periods.select(*KEYS, F.col("period").alias("_p")), list(KEYS)).groupBy(*KEYS).agg(
        F.sum(F.when(F.col("severity") == 4, F.col("duration_s")).otherwise(0.0)).alias("critical"),
        F.sum(F.when(F.col("severity") < 4, F.greatest(F.lit(0), F.bround(F.col("duration_s") / F.col("_p"), 0).cast("long") - 1)).otherwise(0)).alias("by_gaps"),
    )
    out = rates.join(periods, list(KEYS)).join(by_gap, list(KEYS), "left").join(stalled, list(KEYS), "left").join(ends, "mission_id")
    out = out.fillna(0, ["critical", "by_gaps", "stall_s"]).withColumn("expected_hz", hz)
    active = F.greatest(F.lit(1e-9), F.col("t_end") - F.col("first_t") - F.greatest("critical", "stall_s"))
    out = out.withColumn("expected_n", hz * active).withColumn("count_based", F.greatest(F.lit(0), F.bround("expected_n", 0).cast("long") - F.col("n")))
    out = out.withColumn("gap_based", F.greatest(F.lit(0), F.col("by_gaps") - F.bround(F.col("stall_s") * hz, 0).cast("long")))
    most = F.greatest("count_based", "gap_based")
    out = out.withColumn("rate", F.when(F.col("expected_n") > 0, most / F.col("expected_n")).otherwise(0.0))
    quiet = (F.col("rate") < F.greatest(F.lit(0.02), 4 * F.col("period_cv") / F.sqrt(F.lit(50.0)))) | (most < 5) | (F.col("n") < 2)
    out = out.withColumn("agreement", 1 - F.abs(F.col("count_based") - F.col("gap_based")) / F.greatest(most, F.lit(1)))
    level = F.when(F.col("rate") >= 0.30, 4).when(F.col("rate") >= 0.10, 3).when(F.col("rate") >= 0.03, 2).otherwise(1)
    return out.withColumn("dropped", F.when(quiet, 0).otherwise(most)).select(*KEYS, "expected_hz", "count_based", "gap_based", "dropped", "rate", "agreement", "period_cv", F.when(F.col("dropped") > 0, level).otherwise(0).alias("severity"))
