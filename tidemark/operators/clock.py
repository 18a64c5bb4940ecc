"""Two clocks: backward jumps, steps and recorder lag. arrivals carry pub_us beside us."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.operators.cadence import per_topic
from tidemark.operators.series import ewma
from tidemark.sources.events import KEYS


def with_clock(arrivals: DataFrame) -> DataFrame:
    """Adds pub_t on the scale of t, the step of each clock and their divergence."""
    w = per_topic()
    out = arrivals.withColumn("pub_t", F.col("t") - (F.col("us") - F.col("pub_us")) / F.lit(1e6))
    return out.withColumn("d_log", (F.col("us") - F.lag("us").over(w)) / F.lit(1e6)).withColumn("d_pub", (F.col("pub_us") - F.lag("pub_us").over(w)) / F.lit(1e6)).withColumn("divergence", F.round(F.col("d_log") - F.col("d_pub"), 6))


def backward(clocked: DataFrame) -> DataFrame:
    """(keys, jumps, largest): how often a topic's publish time runs back."""
    return clocked.groupBy(*KEYS).agg(F.sum((F.col("d_pub") < 0).cast("long")).alias("jumps"), F.coalesce(F.max(F.when(F.col("d_pub") < 0, -F.col("d_pub"))), F.lit(0.0)).alias("largest"))


def steps(clocked: DataFrame, least: float = 0.5) -> DataFrame:
    """Arrivals whose two clocks moved apart by more than least seconds."""
    out = clocked.where(F.abs("divergence") > least)
    return out.select(*KEYS, "seq", "t", "divergence", F.when(F.col("divergence") > 0, "forward").otherwise("backward").alias("direction"))


def lag(clocked: DataFrame) -> DataFrame:
    """(mission_id, mean_lag, peak_lag, first_lag, last_lag) of log time behind publish time."""
    d = (F.col("us") - F.col("pub_us")) / F.lit(1e6)
    return clocked.groupBy("mission_id").agg(F.avg(d).alias("mean_lag"), F.max(F.abs(d)).alias("peak_lag"), F.min_by(d, F.struct("us", "seq")).alias("first_lag"), F.max_by(d, F.struct("us", "seq")).alias("last_lag"))


def events(clocked: DataFrame, least: float = 0.5, apart: float = 1.0) -> DataFrame:
    """(mission_id, kind, topic, t, size): steps and backward jumps of a recording's publishing clock, topics together.

    Of the candidates of one kind, in publishing time, one counts if it is so many seconds after the last that counted;
    only candidates, which are few, go through the fold of a recording.
    """
    step = F.when(F.abs("divergence") > least, F.struct(F.lit("step").alias("kind"), F.col("divergence").alias("size")))
    back = F.when(F.col("d_pub") < 0, F.struct(F.lit("backward").alias("kind"), (-F.col("d_pub")).alias("size")))
    rows = clocked.select("mission_id", "topic", "seq", "us", "t", F.col("pub_us"), F.explode(F.array_compact(F.array(step, back))).alias("e")).select("*", "e.*").drop("e")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["us", "seq"])
        last, keep = {}, []
        for kind, pub in zip(part.kind, part.pub_us / 1e6, strict=True):
            ok = pub - last.get(kind, -math.inf) >= apart if kind == "step" else pub - last.get(kind, -math.inf) > apart
            keep.append(ok)
            if ok:
                last[kind] = pub
        return part[keep][["mission_id", "kind", "topic", "t", "size"]]

    return rows.groupBy("mission_id").applyInPandas(run, "mission_id string, kind string, topic string, t double, size double")


def lag_trend(clocked: DataFrame, alpha: float = 0.01, least: float = 0.5) -> DataFrame:
    """(mission_id, start_lag, end_lag, growth, peak_lag): the average of log time behind publishing time, in log order.

    Steps of the clock up to an arrival are taken off its lag. A recording is one window.
    """
    steps_ = events(clocked, least).where("kind = 'step'").select("mission_id", "t", "size")
    rows = clocked.select("mission_id", "us", "seq", "t", ((F.col("us") - F.col("pub_us")) / F.lit(1e6)).alias("raw")).unionByName(steps_, allowMissingColumns=True)
    w = Window.partitionBy("mission_id").orderBy("t", F.col("us").isNotNull(), "us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.col("size")
    rows = rows.withColumn("lag", F.col("raw") - F.coalesce(F.sum(signed).over(w), F.lit(0.0))).where("us is not null")
    ends = rows.groupBy("mission_id").agg(F.min_by("lag", F.struct("us", "seq")).alias("start_lag"), F.max(F.abs("lag")).alias("peak_lag"))
    out = ewma(rows, ["mission_id"], alpha, "lag").join(ends, "mission_id")
    return out.select("mission_id", "start_lag", F.col("ewma").alias("end_lag"), (F.col("ewma") - F.col("start_lag")).alias("growth"), "peak_lag")


def report(clocked: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(mission_id, backward, steps, growth, peak_lag, lagging): a recording's clocks; where time runs back, lag says nothing."""
    found = events(clocked, c.step).groupBy("mission_id").agg(F.sum((F.col("kind") == "backward").cast("long")).alias("backward"), F.sum((F.col("kind") == "step").cast("long")).alias("steps"))
    out = lag_trend(clocked, least=c.step).join(found, "mission_id", "left").fillna(0, ["backward", "steps"])
    lagging = (F.col("backward") == 0) & ((F.col("growth") > c.lag_growth) | (F.col("peak_lag") > 0.5))
    return out.select("mission_id", "backward", "steps", "growth", "peak_lag", lagging.alias("lagging"))


def decimated(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows of each key, the first and the last among them."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("_n", F.count("*").over(w))
    sizes = rows.groupBy(*keys).agg(F.max("_n").alias("_n"))
    at = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(n - 1)), 0).cast("long"))))
    chosen = sizes.select(*keys, at.alias("_i"))
    return rows.drop("_n").join(chosen, [*keys, "_i"], "left_semi").withColumnRenamed("_i", "position")
