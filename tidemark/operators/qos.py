"""Delivery settings: their text, and rules on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(text: str | None) -> dict[str, object]:
    """The first profile of a YAML list of settings; deadline in seconds, 0 or missing as None."""
    import yaml

    found = yaml.safe_load(text) if text else None
    one = found[0] if isinstance(found, list) and found else found if isinstance(found, dict) else {}
    d = one.get("deadline") or {}
    seconds = d.get("sec", 0) + d.get("nsec", 0) / 1e9 if isinstance(d, dict) else 0
    return {k: one.get(k) for k in ("history", "depth", "reliability", "durability")} | {"deadline_s": seconds or None}


def checked(profiles: DataFrame, least_hz: float = 20.0, drop: float = 0.02) -> DataFrame:
    """Adds issues to profiles(reliability, history, depth, durability, deadline_s, hz, drop_rate)."""
    rule = lambda when, name: F.when(when, F.lit(name))
    ratio = F.col("deadline_s") * F.col("hz")
    issues = F.array(
        F.when(F.col("reliability") == "best_effort", F.when(F.col("drop_rate") > drop, "best_effort:high").otherwise("best_effort")),
        rule((F.col("history") == "keep_last") & F.col("depth").between(1, 5) & (F.col("hz") >= least_hz), "shallow_queue"),
        rule(F.col("deadline_s").isNotNull() & ((ratio < 1 / 3) | (ratio > 3)), "deadline_mismatch"),
        rule((F.col("durability") == "transient_local") & (F.col("hz") >= least_hz), "transient_local_stream"),
    )
    return profiles.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
