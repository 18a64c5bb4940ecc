"""Log templates, filters, bursts, and lines near outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a template abstracts, in this order
ABSTRACTED = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"(/[\p{L}\p{N}_.-]+){2,}", "<path>"),
    (r"'[^']*'|\"[^\"]*\"", "<str>"),
    (r"(?<![\p{L}\p{N}_.])[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?(?![\p{L}\p{N}_.])", "<num>"),
    (r"\s+", " "),
)


def template(msg: Column) -> Column:
    out = msg
    for pattern, name in ABSTRACTED:
        out = F.regexp_replace(out, pattern, name)
    return F.trim(out)


def clusters(lines: DataFrame, most: int = 200, by: list[str] = ()) -> DataFrame:
    """(by, level, template, n, first_t, last_t, example) of lines(by, level, t, id, msg).

    Templates beyond the first so many to appear (of each recording, where by names columns) fold into one of their
    level called <other>. The example is the first line.
    """
    at, keys = F.struct("t", "id"), [*by, "level", "template"]
    one = lines.withColumn("template", template(F.col("msg"))).groupBy(*keys).agg(F.count("*").alias("n"), F.max("t").alias("last_t"), F.min(at).alias("at"), F.min_by("msg", at).alias("example"))
    first = one.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("_r") <= most) if by else one.orderBy("at").limit(most)
    one = one.join(first.select(*keys, F.lit(True).alias("kept")), keys, "left").withColumn("template", F.when(F.col("kept"), F.col("template")).otherwise("<other>"))
    out = one.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_t").alias("last_t"), F.min("at").alias("at"), F.min_by("example", "at").alias("example"))
    return out.select(*keys, "n", F.col("at.t").alias("first_t"), "last_t", "example")


def matching(lines: DataFrame, level: str | None = None, node: str | None = None, pattern: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    if level is not None:
        lines = lines.where(F.col("level") == level)
    if node is not None:
        lines = lines.where(F.col("node").contains(node))
    if pattern is not None:
        lines = lines.where(F.col("msg").rlike(f"(?i){pattern}"))
    if start is not None:
        lines = lines.where(F.col("t") >= start)
    return lines if end is None else lines.where(F.col("t") <= end)


def bursts(lines: DataFrame, keys: list[str], times: float = 3.0) -> DataFrame:
    """(keys, n, centre) of the fullest of min(20, max(4, n // 3)) bins where it has so many times the mean, or more."""
    s = lines.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("n > 4 and hi > lo")
    s = s.withColumn("bins", F.least(F.lit(20), F.greatest(F.lit(4), F.floor(F.col("n") / 3))))
    at = F.least(F.floor((F.col("t") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1)
    b = lines.join(s, keys).groupBy(*keys, "n", "lo", "hi", "bins", at.alias("bin")).agg(F.count("*").alias("c"))
    best = b.groupBy(*keys, "n", "lo", "hi", "bins").agg(F.min(F.struct((-F.col("c")).alias("neg"), "bin")).alias("b"))
    best = best.where(-F.col("b.neg") > times * F.col("n") / F.col("bins"))
    return best.select(*keys, "n", (F.col("lo") + (F.col("b.bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("centre"))


def near(lines: DataFrame, outliers: DataFrame, keys: list[str], within: float) -> DataFrame:
    """Lines within so many seconds of any outlier(keys, ot)."""
    cell = lambda c: F.floor(F.col(c) / (2 * within)).cast("long")
    o = outliers.select(*keys, "ot", F.explode(F.array(cell("ot") - 1, cell("ot"), cell("ot") + 1)).alias("_cell"))
    left = lines.withColumn("_cell", cell("t")).alias("l")
    cond = [F.col(f"l.{k}") == F.col(f"o.{k}") for k in keys] + [F.col("l._cell") == F.col("o._cell"), F.abs(F.col("l.t") - F.col("o.ot")) <= within]
    return left.join(o.alias("o"), cond, "left_semi").drop("_cell")
