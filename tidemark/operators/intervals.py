"""Intervals: islands, unions, and joins on overlap through buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], start: str, end: str, slack: Column | float = 0.0, tie: str | None = None) -> DataFrame:
    """Adds island, a number that intervals share which are at most slack apart."""
    w = Window.partitionBy(*keys).orderBy(start, end, *([tie] if tie else []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    slack = slack if isinstance(slack, Column) else F.lit(float(slack))
    new = F.when(reach.isNull() | (F.col(start) - reach > slack), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merged(rows: DataFrame, keys: list[str], start: str, end: str, slack: float = 0.0) -> DataFrame:
    """(keys, start, end, pieces) of the unions of intervals that touch or are at most slack apart."""
    out = islands(rows, keys, start, end, slack).groupBy(*keys, "island")
    return out.agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces")).drop("island")


def cells(start: str, end: str, width: float) -> Column:
    """The buckets of time that an interval touches."""
    return F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.greatest(F.col(start), F.col(end)) / width).cast("long"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, strict: bool = True) -> DataFrame:
    """Pairs of left(ls, le, ...) and right(rs, re, ...) that overlap, each once, by equality of keys and buckets.

    A pair counts in the bucket where the later of the two begins.
    """
    a = left.withColumn("_cell", F.explode(cells("ls", "le", width)))
    b = right.withColumn("_cell", F.explode(cells("rs", "re", width)))
    pairs = a.join(b, [*keys, "_cell"]).where(F.floor(F.greatest("ls", "rs") / width) == F.col("_cell"))
    meet = (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) if strict else (F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le"))
    return pairs.where(meet).drop("_cell")


def shared_seconds() -> Column:
    return F.greatest(F.lit(0.0), F.least("le", "re") - F.greatest("ls", "rs"))
