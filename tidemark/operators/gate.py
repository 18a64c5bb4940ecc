"""Decisions on recordings as training data, a quality gate against a baseline, and detector scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import overlapping


@dataclass(frozen=True)
class Policy:
    # fixed values: published defaults
    least_s: float = 1.0
    stall: float = 0.02
    loss: float = 0.05
    lag_s: float = 1.0
    gap_s: float | None = None
    score: float | None = None
    topics: tuple[str, ...] = ()


def reasons(p: Policy) -> Column:
    """Reason codes of a recording in order; its columns are verdict, t_end, stalled_s, loss, lag_s, longest_gap_s, score, backward, truncated, corrupt_share and topics."""
    rule = lambda when, code: F.when(when, F.lit(code))
    rules = [
        rule(F.col("verdict") == "unassessable", "unassessable"),
        rule(F.col("t_end") < p.least_s, "too_short"),
        rule(F.col("truncated"), "truncated"),
        rule(F.col("corrupt_share") > 0.01, "corrupt"),
        rule(F.col("backward") > 0, "clock_non_monotonic"),
        *[rule(~F.array_contains("topics", t), f"missing_topic:{t}") for t in p.topics],
        rule(F.col("stalled_s") / F.col("t_end") > p.stall, "recorder_stall"),
        *([rule(F.col("longest_gap_s") > p.gap_s, "gap")] if p.gap_s is not None else []),
        rule(F.col("lag_s") > p.lag_s, "clock_lag"),
        rule(F.col("loss") > p.loss, "message_loss"),
        *([rule(F.col("score") < p.score, "low_score")] if p.score is not None else []),
        rule(F.col("verdict") == "compromised", "compromised"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def decided(recordings: DataFrame, p: Policy) -> DataFrame:
    """Adds reasons and decision: reject for any reason, review if compromised is the only one, else accept."""
    out = recordings.withColumn("reasons", reasons(p))
    return out.withColumn("decision", F.when(F.size("reasons") == 0, "accept").when(F.array_join("reasons", ",") == "compromised", "review").otherwise("reject"))


def summary(episodes: DataFrame) -> DataFrame:
    """(decision, n, seconds)."""
    return episodes.groupBy("decision").agg(F.count("*").alias("n"), F.sum("t_end").alias("seconds"))


def rejections(episodes: DataFrame) -> DataFrame:
    """(code, n) of reasons, most frequent first."""
    return episodes.select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def against_baseline(now: DataFrame, baseline: DataFrame, key: str, least: float, drop: float, rank: int = 1) -> DataFrame:
    """(key, score, before, passed): the verdict at least degraded (rank 1), the score high enough and not fallen too far."""
    order = F.when(F.col("verdict") == "healthy", 2).when(F.col("verdict") == "degraded", 1).when(F.col("verdict") == "compromised", 0).otherwise(-1)
    out = now.join(baseline.select(key, F.col("score").alias("before")), key, "left")
    return out.withColumn("passed", (order >= rank) & (F.col("score") >= least) & (F.col("before").isNull() | (F.col("before") - F.col("score") <= drop)))


#: Which detectors' findings answer for a kind of label.
ANSWERS = {"gap": ["gap", "stall", "subsystem"], "stall": ["stall", "subsystem", "gap"], "rate": ["rate_degradation"], "jitter": ["jitter"], "dropped": ["dropped", "gap"], "clock": ["clock", "clock_step"], "clock_lag": ["clock_lag"], "file": ["file_integrity"]}


def answering(truth: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """truth(kind) and found(detector) with kind on both: a finding stands once for each kind it answers for."""
    pairs = [(d, k) for k, ds in ANSWERS.items() for d in ds]
    of = truth.sparkSession.createDataFrame(pairs, "detector string, kind string")
    return truth, found.join(F.broadcast(of), "detector")  # a few rows


def false_alarms(found: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """(recordings, alarms, per_recording): findings in recordings that are known to be clean(key)."""
    n = clean.join(found.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    out = n.agg(F.count("*").alias("recordings"), F.coalesce(F.sum("_n"), F.lit(0)).alias("alarms"))
    return out.withColumn("per_recording", F.when(F.col("recordings") > 0, F.col("alarms") / F.col("recordings")).otherwise(0.0))


def matched(truth: DataFrame, found: DataFrame, keys: list[str], tolerance: float, cell: float) -> DataFrame:
    """(tp, fn, fp, precision, recall, f1) of truth(keys, id, lo, hi) windows and found(keys, id, lo, hi); 1 where undefined."""
    a = truth.select(*keys, F.col("id").alias("tid"), (F.col("lo") - tolerance).alias("ls"), (F.col("hi") + tolerance).alias("le"))
    b = found.select(*keys, F.col("id").alias("fid"), F.col("lo").alias("rs"), F.col("hi").alias("re"))
    hits = overlapping(a, b, keys, cell, strict=False)
    n = truth.agg(F.count("*").alias("nt")).crossJoin(found.agg(F.count("*").alias("nf"))).crossJoin(hits.agg(F.countDistinct(*keys, "tid").alias("tp"), F.countDistinct(*keys, "fid").alias("ok")))
    out = n.select("tp", (F.col("nt") - F.col("tp")).alias("fn"), (F.col("nf") - F.col("ok")).alias("fp"))
    out = out.withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)).withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
