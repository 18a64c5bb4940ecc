"""Findings of all detectors in one form, those related to one, and what must not be concluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.operators.health import rolled_up
from tidemark.operators.intervals import overlapping

#: Findings of a kind that one recording has at most, the first ones.
STALLS, SUBSYSTEMS, RELATED = 50, 20, 10
FORM = ["detector", "severity", "mission_id", "topic", "t_start", "t_end", "value", "rolled_up"]


def _form(rows: DataFrame, detector: str, severity: Column, value: Column, topic: Column | None = None, rolled: Column | None = None) -> DataFrame:
    topic = F.col("topic") if topic is None else topic
    rolled = F.lit(0).cast("long") if rolled is None else rolled
    return rows.select(F.lit(detector).alias("detector"), severity.cast("int").alias("severity"), "mission_id", topic.cast("string").alias("topic"), "t_start", "t_end", value.cast("double").alias("value"), rolled.alias("rolled_up"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """Of each recording the first rows by time."""
    w = Window.partitionBy("mission_id").orderBy("t_start", "t_end", *(["topic"] if "topic" in rows.columns else []))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def findings(found: dict[str, DataFrame], c: Config = ROBOT) -> DataFrame:
    """(detector, severity, mission_id, topic, t_start, t_end, value, rolled_up) of what audited() found.

    The value is a gap's periods, a drift's relative slope, jitter's peak, the rate of loss, the share of silent topics,
    or a count. Gaps that lie in a stall for four fifths are not findings of their own: the stall counts them.
    Severities go from 0 for information to 4.
    """
    whole = found["ends"].select("mission_id", F.lit(0.0).alias("t_start"), "t_end")
    assessed = found["topics"].where("status = 'assessed'").select("mission_id", "topic")
    gaps = rolled_up(found["silences"].join(assessed, ["mission_id", "topic"], "left_semi"), found["stalls"])
    inside = gaps.where("stall is not null").groupBy("mission_id", "stall").agg(F.count("*").alias("held"))
    stalls = _first(found["stalls"].drop("topics"), STALLS).join(inside, ["mission_id", "stall"], "left")
    shared = found["gaps"].where("class = 'subsystem' and co_silent >= 2").where(F.col("concurrency").between(c.isolated, c.system_wide))
    drops = found["drops"].join(assessed, ["mission_id", "topic"], "left_semi").where("dropped > 0").join(found["topics"].select("mission_id", "topic", "first_t"), ["mission_id", "topic"])
    drops = drops.join(whole.drop("t_start"), "mission_id").withColumn("t_start", F.col("first_t"))
    blind = found["topics"].where("status <> 'assessed'").select("mission_id", "topic", "n").join(whole, "mission_id")
    parts = [
        _form(gaps.where("stall is null"), "gap", F.col("severity"), F.col("periods")),
        _form(found["drifts"].join(assessed, ["mission_id", "topic"], "left_semi"), "rate_degradation", F.col("severity"), F.col("slope")),
        _form(found["jitter"].join(assessed, ["mission_id", "topic"], "left_semi"), "jitter", F.col("severity"), F.col("peak")),
        _form(drops, "dropped", F.col("severity"), F.col("rate")),
        _form(stalls, "stall", F.when(F.col("t_end") - F.col("t_start") > 5, 4).otherwise(3), F.col("concurrency"), F.lit(None), F.coalesce("held", F.lit(0).cast("long"))),
        _form(_first(shared, SUBSYSTEMS), "subsystem", F.lit(3), F.col("concurrency")),
        _form(found["implausible"].join(whole, "mission_id"), "implausible_stalls", F.lit(0), F.col("rejected"), F.lit(None)),
        _form(blind, "unassessable", F.lit(0), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def related(chosen: DataFrame, all_: DataFrame, cell: float = 3600.0) -> DataFrame:
    """Each chosen finding with related, how many others of its recording overlap it, and kinds, the detectors of ten of them."""
    name = F.struct("detector", F.coalesce("topic", F.lit("")).alias("topic"), "t_start", "t_end")
    a = chosen.select("mission_id", name.alias("one"), F.col("t_start").alias("ls"), F.col("t_end").alias("le"))
    b = all_.select("mission_id", name.alias("other"), F.col("severity").alias("s"), F.col("t_start").alias("rs"), F.col("t_end").alias("re"))
    pairs = overlapping(a, b, ["mission_id"], cell, strict=False).where("one <> other")
    rank = F.row_number().over(Window.partitionBy("mission_id", "one").orderBy(F.desc("s"), "rs", "other"))
    out = pairs.withColumn("_r", rank).groupBy("mission_id", "one").agg(F.count("*").alias("related"), F.array_sort(F.collect_set(F.when(F.col("_r") <= RELATED, F.col("other.detector")))).alias("kinds"))
    mine = chosen.select("mission_id", name.alias("one"), *[x for x in chosen.columns if x != "mission_id"])
    return mine.join(out, ["mission_id", "one"], "left").drop("one").withColumn("related", F.coalesce("related", F.lit(0).cast("long"))).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def caveats(found: dict[str, DataFrame], findings_: DataFrame, clocks: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(mission_id, place, caveat): sentences in the order in which a reader needs them.

    clocks(mission_id, backward, lagging) and files(mission_id, incomplete, corrupt_share) are optional.
    """
    say = lambda rows, section, topic, text: rows.select("mission_id", F.lit(section).alias("section"), topic.alias("by"), text.alias("caveat"))
    none = F.lit("")
    r = found["recordings"]
    refused = F.lit("This recording cannot be judged: that little was found does not mean that it is sound.")
    reasons = F.concat(F.lit("Assessed are "), F.col("assessed"), F.lit(" of "), F.col("topics"), F.lit(" topics with "), F.round(100 * F.col("assessed_messages") / F.col("messages"), 0).cast("int"), F.lit(" % of the messages over "), F.format_string("%.1f", "t_end"), F.lit(" s."))
    worst = findings_.where("detector = 'gap' and severity >= 2").groupBy("mission_id", "topic").agg(F.max_by(F.struct("t_start", "t_end"), F.struct("severity", -F.col("t_start"))).alias("g"))
    lost = found["topics"].withColumn("share", 100 * F.col("dropped") / (F.col("n") + F.col("dropped"))).where("dropped > 0 and share >= 5")
    drift = findings_.where("detector = 'rate_degradation'").groupBy("mission_id").agg(F.array_sort(F.collect_set("topic")).alias("t"))
    named = F.concat(F.array_join(F.slice("t", 1, 8), ", "), F.when(F.size("t") > 8, F.concat(F.lit(" and "), F.size("t") - 8, F.lit(" more"))).otherwise(""))
    parts = [
        say(r.where("verdict = 'unassessable'"), 0, none, refused),
        say(r.where("verdict = 'unassessable'"), 1, none, reasons),
        say(worst, 2, F.col("topic"), F.concat(F.col("topic"), F.format_string(" was silent from %.1f to %.1f s; rates, counts and coverage over that time mean nothing.", "g.t_start", "g.t_end"))),
        say(lost, 3, F.col("topic"), F.concat(F.col("topic"), F.format_string(" lost about %.0f %% of its messages; statistics of its messages are biased.", "share"))),
        say(drift, 4, none, F.concat(F.lit("Rates drifted ("), named, F.lit("); early and late parts compare only by rate."))),
        say(findings_.where("detector = 'stall'").select("mission_id").distinct(), 7, none, F.lit("A silence was of all topics at once; it tells of the recorder, not of a sensor.")),
    ]
    if clocks is not None:
        parts.append(say(clocks.where("backward > 0"), 5, none, F.lit("Time runs backwards in places; ranges and durations across them are unreliable.")))
        parts.append(say(clocks.where("lagging"), 6, none, F.lit("The recorder fell behind; losses late in the file are likely where no gap is listed.")))
    if files is not None:
        parts.append(say(files.where("incomplete"), 8, none, F.lit("The file is incomplete; nothing after its last record is known.")))
        parts.append(say(files.where("corrupt_share > 0.01"), 9, none, F.concat(F.format_string("%.0f", 100 * F.col("corrupt_share")), F.lit(" % of the messages do not decode; all figures are of the rest."))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy("section", "by"))
    return out.withColumn("place", place).select("mission_id", "place", "caveat")
