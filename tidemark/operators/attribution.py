"""What signals do before stalls, and how stalls are spread over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dispersion(stalls: DataFrame, ends: DataFrame, window: float = 30.0) -> DataFrame:
    """(mission_id, n, index, pattern) from stalls per window: population variance over mean, empty windows included; NaN without stalls."""
    grid = ends.select("mission_id", "t_end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("t_end") / window))).alias("w"))
    counts = stalls.groupBy("mission_id", F.floor(F.col("t_start") / window).alias("w")).agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    index = F.when(F.sum("c") > 0, F.var_pop(c) / F.avg(c)).otherwise(float("nan"))
    out = grid.join(counts, ["mission_id", "w"], "left").groupBy("mission_id").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), index.alias("index"), F.max("t_end").alias("e"))
    pattern = F.when((F.col("n") < 4) | (F.col("e") <= window), "unknown").when(F.col("index") > 2, "clustered").when(F.col("index") < 0.5, "periodic").otherwise("random")
    return out.select("mission_id", "n", "index", pattern.alias("pattern"))


def attribution(samples: DataFrame, stalls: DataFrame, keys: list[str], pre: float, guard: float, cell: float) -> DataFrame:
    """(keys, n_pre, n_base, d, consistency, verdict) of samples(keys, mission_id, seq, t, v) against merged stalls.

    A sample inside a stall or its guard counts nowhere, one within pre seconds before a stall counts for it, all
    others are the baseline.
    """
    near = stalls.select("mission_id", "stall", "t_start", "t_end", F.explode(F.sequence(F.floor((F.col("t_start") - F.greatest(F.lit(pre), F.lit(guard))) / cell).cast("long"), F.floor((F.col("t_end") + guard) / cell).cast("long"))).alias("_cell"))
    rows = samples.withColumn("_cell", F.floor(F.col("t") / cell).cast("long"))
    hit = rows.join(near, ["mission_id", "_cell"], "left")
    inside = (F.col("t") >= F.col("t_start")) & (F.col("t") <= F.col("t_end"))
    before = (F.col("t") < F.col("t_start")) & (F.col("t") >= F.col("t_start") - pre)
    around = (F.col("t") >= F.col("t_start") - guard) & (F.col("t") <= F.col("t_end") + guard)
    one = hit.groupBy("seq", "mission_id", *[k for k in keys if k != "mission_id"], "t", "v").agg(F.max(F.coalesce(inside, F.lit(False))).alias("i"), F.min(F.when(before, F.struct("t_start", "stall"))).alias("p"), F.max(F.coalesce(around, F.lit(False))).alias("g"))
    one = one.withColumn("class", F.when(F.col("i"), "inside").when(F.col("p").isNotNull(), "pre").when(F.col("g"), "guard").otherwise("base"))
    side = lambda f, c: f(F.when(F.col("class") == c, F.col("v")))
    all_ = one.groupBy(*keys).agg(*[side(f, c).alias(f"{n}_{c}") for c in ("pre", "base") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    each = one.where("class = 'pre'").groupBy(*keys, "p.stall").agg(F.avg("v").alias("sm"), F.count("v").alias("sn")).where("sn >= 2")
    shift = each.join(all_, keys).groupBy(*keys).agg(F.count("*").alias("stalls"), F.avg((F.sign(F.col("sm") - F.col("m_base")) == F.sign(F.col("m_pre") - F.col("m_base"))).cast("double")).alias("consistency"))
    out = all_.join(shift, keys, "left")
    pooled = F.sqrt((F.col("v_pre") + F.col("v_base")) / 2)
    d = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("m_pre") - F.col("m_base")) / pooled))
    out = out.withColumn("d", F.when((F.col("n_pre") >= 10) & (F.col("n_base") >= 50) & (pooled > 0), d))
    explains = (F.abs("d") >= 0.5) & (F.col("consistency") >= 0.7) & (F.col("stalls") >= 3)
    return out.select(*keys, "n_pre", "n_base", "d", "consistency", F.when(F.col("d").isNull(), "no_data").when(explains, "attributed").otherwise("unexplained").alias("verdict"))
