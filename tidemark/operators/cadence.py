"""Inter-arrival times and the period a topic learns from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.sources.events import KEYS
from tidemark.sources.tables import kept

ORDER = ("us", "seq")


def per_topic() -> Window:
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def interarrival(arrivals: DataFrame) -> DataFrame:
    """Adds dt (null at first), n (from 1) and first_t."""
    w = per_topic()
    return arrivals.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("n", F.row_number().over(w).cast("long")).withColumn("first_t", F.first("t").over(w))


def log_bin(dt: Column, c: Config) -> Column:
    scale = c.bins / (math.log(c.hi) - math.log(c.lo))
    at = F.floor((F.log(F.least(F.greatest(dt, F.lit(c.lo)), F.lit(c.hi))) - F.lit(math.log(c.lo))) * F.lit(scale))
    return F.least(at, F.lit(c.bins - 1)).cast("int")


def centre(bin_: Column, c: Config) -> Column:
    scale = c.bins / (math.log(c.hi) - math.log(c.lo))
    return F.exp(F.lit(math.log(c.lo)) + (bin_ + F.lit(0.5)) / F.lit(scale))


def histogram(ia: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, bin, n) of positive inter-arrivals."""
    return ia.where("dt > 0").groupBy(*KEYS, log_bin(F.col("dt"), c).alias("bin")).agg(F.count("*").alias("n"))


def mode(ia: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, bin, n, mode_s): the fullest bin, the lowest of equals."""
    best = histogram(ia, c).groupBy(*KEYS).agg(F.min(F.struct((-F.col("n")).alias("neg"), "bin")).alias("b"))
    return best.select(*KEYS, F.col("b.bin").alias("bin"), (-F.col("b.neg")).alias("n"), centre(F.col("b.bin"), c).alias("mode_s"))


def warmed(ia: DataFrame, c: Config = ROBOT) -> DataFrame:
    """Adds warm_n, the number of the arrival at which the topic is warm, to all its rows; null where it never is."""
    warm = (F.col("dt") > 0) & (F.col("n") >= c.warm_messages) & (F.col("t") - F.col("first_t") >= c.warm_seconds)
    return ia.withColumn("warm_n", F.min(F.when(warm, F.col("n"))).over(Window.partitionBy(*KEYS)))


def positive(ia: DataFrame, c: Config = ROBOT) -> DataFrame:
    """Rows with dt > 0: pr numbers them, run_mode is the mode so far, run_median the median of the first five at most."""
    w = per_topic()
    counted = ia.where("dt > 0").withColumn("pr", F.row_number().over(w).cast("long")).withColumn("bin", log_bin(F.col("dt"), c))
    counted = counted.withColumn("_c", F.count("*").over(Window.partitionBy(*KEYS, "bin").orderBy(*ORDER)))
    counted = counted.withColumn("_m", F.max("_c").over(w))
    same = Window.partitionBy(*KEYS, "_m").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("mode_bin", F.min(F.when(F.col("_c") == F.col("_m"), F.col("bin"))).over(same))
    few = F.array_sort(F.array_compact(F.array(*[F.lag("dt", k).over(w) if k else F.col("dt") for k in range(4)])))
    half = F.size(few) / 2
    median = (F.element_at(few, F.floor(half + 0.5).cast("int")) + F.element_at(few, F.floor(half + 1).cast("int"))) / 2
    return counted.withColumn("run_mode", centre(F.col("mode_bin"), c)).withColumn("run_median", F.when(F.col("pr") < 5, median)).drop("_c", "_m")


def learned(pos: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, warm_n, period, period_cv) of topics that are warm, from positive rows that have warm_n."""
    ring = pos.where("n <= warm_n")
    ring = ring.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("pr")))).where(F.col("_r") <= c.ring)
    at = ring.groupBy(*KEYS, "warm_n").agg(F.max_by("run_mode", "pr").alias("mode_s"), F.collect_list("dt").alias("dts"))
    median = lambda x: F.when(F.size(x) > 0, (F.element_at(F.array_sort(x), F.floor((F.size(x) + 1) / 2).cast("int")) + F.element_at(F.array_sort(x), F.floor(F.size(x) / 2 + 1).cast("int"))) / 2)
    at = at.withColumn("wide", F.filter("dts", lambda d: (d > 0.5 * F.col("mode_s")) & (d < 1.5 * F.col("mode_s"))))
    at = at.withColumn("o1", F.coalesce(median(F.col("wide")), F.col("mode_s")))
    at = at.withColumn("narrow", F.filter("wide", lambda d: F.abs(d - F.col("o1")) < c.refine * F.col("o1")))
    at = at.withColumn("period", F.coalesce(median(F.col("narrow")), F.col("o1")))
    k = F.size("narrow")
    mean = F.aggregate("narrow", F.lit(0.0), lambda a, x: a + x) / k
    sd = F.sqrt(F.aggregate(F.transform("narrow", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (k - 1))
    return at.select(*KEYS, "warm_n", "period", F.when(k > 2, sd / mean).otherwise(F.lit(0.02)).alias("period_cv"))


def declared_period(observed: Column, declared: Column) -> Column:
    """A declared period holds where it is within a third and three times the observed one."""
    return F.when(declared.between(observed / 3, observed * 3), declared).otherwise(observed)


def with_declared(periods: DataFrame, declared: DataFrame) -> DataFrame:
    """periods with those of declared(keys, declared_s) where they hold, and mismatch where they don't; observed is what was learned."""
    out = periods.join(declared.where("declared_s > 0").select(*KEYS, "declared_s"), list(KEYS), "left").withColumn("observed", F.col("period"))
    out = out.withColumn("period", declared_period(F.col("observed"), F.col("declared_s")))
    return out.withColumn("mismatch", F.coalesce(F.col("period") != F.col("declared_s"), F.lit(False)))


def timed_of(ia: DataFrame, c: Config = ROBOT, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """timed() of rows that warmed() has made. A declared period that holds goes before a learned one."""
    early = positive(ia.where("warm_n is null or n <= warm_n"), c)
    periods = learned(early, c)
    periods = kept(periods if declared is None else with_declared(periods, declared))
    late = ia.where("dt > 0 and n >= warm_n").join(periods.select(*KEYS, "period"), list(KEYS))
    early = early.where("warm_n is null or n < warm_n").withColumn("period", F.when(F.col("pr") >= 5, F.col("run_mode")).otherwise(F.col("run_median")))
    if declared is not None:  # before a topic is warm, what it declares stands
        early = early.join(declared.where("declared_s > 0").select(*KEYS, "declared_s"), list(KEYS), "left").withColumn("period", F.coalesce("declared_s", "period"))
    return late.unionByName(early.select(*late.columns)), periods


def timed(arrivals: DataFrame, c: Config = ROBOT, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with dt > 0 and their period as it stood, and the learned periods (a row for each topic, kept).

    The period is the learned one once a topic is warm, else the running mode, else the running median. Running modes
    are worked out for the beginnings of topics only, which are short: rows after them take one sort by topic.
    """
    return timed_of(warmed(interarrival(arrivals), c), c, declared)


def rates(arrivals: DataFrame) -> DataFrame:
    """(keys, n, first_t, last_t, sustained_hz, mean_dt): sustained_hz is the count over last - first."""
    out = arrivals.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    span = F.col("last_t") - F.col("first_t")
    return out.withColumn("sustained_hz", F.when(span > 0, F.col("n") / span)).withColumn("mean_dt", F.when(F.col("n") > 1, span / (F.col("n") - 1)))
