"""Redaction before any consumer sees a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "[redacted]"


def hidden(topic: Column, patterns: list[str]) -> Column:
    """Whether a topic matches a name, or a beginning that ends in *."""
    out = F.lit(False)
    for p in patterns:
        out = out | (topic.startswith(p[:-1]) if p.endswith("*") else topic == p)
    return out


def redacted(rows: DataFrame, topics: list[str], fields: list[str]) -> DataFrame:
    """rows without hidden topics; fields, given as dotted paths into columns, hold a constant."""
    out = rows.where(~hidden(F.col("topic"), topics)) if topics else rows
    for path in fields:
        top, _, rest = path.partition(".")
        out = out.withColumn(top, F.col(top).withField(rest, F.lit(MASK)) if rest else F.lit(MASK))
    return out
