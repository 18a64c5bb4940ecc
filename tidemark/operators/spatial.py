"""Trajectories and transform trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Points of a plan: 16 bytes each go to every task.
PLAN = 100_000


def steps(points: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, us, seq, t, x, y, z) with step lengths and the speed in the plane."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    d = {c: F.col(c) - F.lag(c).over(w) for c in ("x", "y", "z", "t")}
    out = points.withColumns({f"d{c}": e for c, e in d.items()})
    out = out.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return out.withColumn("speed", F.when(F.col("dt") > 0, F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.col("dt")))


def summary(points: DataFrame, keys: list[str]) -> DataFrame:
    at = F.struct("us", "seq")
    out = steps(points, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("step").alias("length"), F.max("speed").alias("max_speed"), *[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))], *[F.max_by(c, at).alias(f"_b{c}") for c in "xyz"], *[F.min_by(c, at).alias(f"_a{c}") for c in "xyz"])
    d = [F.col(f"_b{c}") - F.col(f"_a{c}") for c in "xyz"]
    return out.withColumn("displacement", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).drop(*[f"_{s}{c}" for s in "ab" for c in "xyz"])


def stops(points: DataFrame, keys: list[str], slow: float, least: float = 1.0) -> DataFrame:
    """(keys, t_start, t_end) of runs slower than slow; a run ends at the first moving sample, an open one at the last."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    rows = steps(points, keys).where("speed is not null").withColumn("still", (F.col("speed") < slow).cast("int"))
    rows = rows.withColumn("next_t", F.coalesce(F.lead("t").over(w), F.col("t"))).withColumn("flip", F.when(F.col("still") != F.lag("still", 1, 0).over(w), 1).otherwise(0)).withColumn("run", F.sum("flip").over(w))
    out = rows.where("still = 1").groupBy(*keys, "run").agg(F.min("t").alias("t_start"), F.max("next_t").alias("t_end"))
    return out.where(F.col("t_end") - F.col("t_start") >= least).drop("run")


def curvature(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_curvature): four times the area over the product of the sides of three points in a row."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    p = points.withColumns({f"{c}{s}": f(c).over(w) for c in "xy" for s, f in (("p", F.lag), ("n", F.lead))}).where("xp is not null and xn is not null")
    side = lambda a, b: F.sqrt((F.col(f"x{a}") - F.col(f"x{b}")) ** 2 + (F.col(f"y{a}") - F.col(f"y{b}")) ** 2)
    cross = F.abs((F.col("x") - F.col("xp")) * (F.col("yn") - F.col("yp")) - (F.col("y") - F.col("yp")) * (F.col("xn") - F.col("xp")))
    product = side("", "p") * side("n", "") * side("n", "p")
    return p.groupBy(*keys).agg(F.avg(F.when(product > 1e-12, 2 * cross / product).otherwise(0.0)).alias("mean_curvature"))


def deviation(points: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, max) distance of points from the nearest point of plan(px, py), a polyline of one message.

    The plan goes to all tasks; one of over PLAN points is refused.
    """
    if plan.limit(PLAN + 1).count() > PLAN:
        raise ValueError(f"a plan has {PLAN} points at most")
    near = points.crossJoin(F.broadcast(plan)).groupBy(*keys, "seq").agg(F.min(F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)).alias("d"))
    return near.groupBy(*keys).agg(F.avg("d").alias("mean_deviation"), F.max("d").alias("max_deviation"))


def edges(transforms: DataFrame) -> DataFrame:
    """(parent, child, n, first_t, last_t, max_gap, jumps) of transforms(parent, child, us, seq, t, x, y)."""
    w = Window.partitionBy("parent", "child").orderBy("us", "seq")
    rows = transforms.withColumn("g", F.col("t") - F.lag("t").over(w)).withColumn("j", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    return rows.groupBy("parent", "child").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("g").alias("max_gap"), F.sum((F.coalesce("j", F.lit(0.0)) > 1).cast("long")).alias("jumps"))


def roots(edges_: DataFrame) -> DataFrame:
    """Parents that are never children."""
    return edges_.select("parent").distinct().join(edges_.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
