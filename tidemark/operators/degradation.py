"""Rates that drift: averages of spacings read in buckets, tested for a trend over the last ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.operators.cadence import ORDER, per_topic
from tidemark.operators.series import ewma_rows
from tidemark.sources.events import KEYS

#: |z| from which on Kendall's test is significant at 5 %.
CRITICAL = 1.959963984540054


def rate_buckets(timed: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, k, x, hz, base_hz): what the average of spacings said when the k-th bucket closed, and at what rate.

    Spacings over five periods are left out. The first one opens the buckets; x is the middle of bucket k.
    """
    rows = timed.where(F.col("period").isNull() | (F.col("dt") <= 5 * F.col("period")))
    rows = ewma_rows(rows, list(KEYS), c.ewma, "dt", ORDER)
    rows = rows.withColumn("_t0", F.first("t").over(per_topic().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_b", F.floor((F.col("t") - F.col("_t0")) / c.bucket).cast("long"))
    rows = rows.withColumn("_a", F.lag("_b", 1, 0).over(per_topic())).where("_b > _a and ewma > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    return rows.select(*KEYS, "k", (F.col("_t0") + (F.col("k") + 0.5) * c.bucket).alias("x"), (1 / F.col("ewma")).alias("hz"), (1 / F.col("period")).alias("base_hz"))


def trends(hz: np.ndarray, base: np.ndarray, c: Config = ROBOT) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: the relative slope over the last ones, and whether it is one; nan where there are too few."""
    n, keep = len(hz), c.bucket_keep
    rel, z = np.full(n, np.nan), np.zeros(n)

    def test(w: np.ndarray, at: np.ndarray) -> None:
        m = w.shape[1]
        i, j = np.triu_indices(m, 1)
        d = w[:, j] - w[:, i]
        slope = np.median(d / ((j - i) * c.bucket), axis=1)
        s, some = np.sign(d).sum(1), np.abs(np.sign(d)).sum(1)
        z[at] = np.abs(s / np.maximum(some, 1)) / math.sqrt(2 * (2 * m + 5) / (9 * m * (m - 1)))
        rate = np.where(np.isfinite(base[at]), base[at], w.mean(1))
        rel[at] = slope * (m - 1) * c.bucket / rate

    for m in range(c.bucket_least, min(n, keep - 1) + 1):
        test(hz[None, :m], np.array([m - 1]))
    if n >= keep:
        windows = np.lib.stride_tricks.sliding_window_view(hz, keep)
        for a in range(0, len(windows), 1000):
            test(windows[a : a + 1000], np.arange(a, min(a + 1000, len(windows))) + keep - 1)
    with np.errstate(invalid="ignore"):
        return rel, (np.abs(rel) > c.drift) & (z > CRITICAL)


def level(rel: float) -> int:
    return 3 if abs(rel) >= 0.4 else 2 if abs(rel) >= 0.2 else 1


def episodes(x: np.ndarray, hz: np.ndarray, base: np.ndarray, t_end: float, c: Config = ROBOT) -> list[list[float]]:
    """[t_start, t_end, relative slope, severity, rate at the start, rate at the end, episodes] of drifts.

    An episode opens where a trend shows, at the first bucket of its window, and closes where none does. The steepest
    trend counts. One that begins before the last one's end extends it.
    """
    rel, firing = trends(hz, base, c)
    out: list[list[float]] = []
    open_: tuple[float, float, float] | None = None

    def close(end: float, last: float) -> None:
        start, peak, first = open_
        if out and out[-1][1] >= start:
            out[-1][1], out[-1][3] = max(out[-1][1], end), max(out[-1][3], level(peak))
            out[-1][5], out[-1][6] = last, out[-1][6] + 1
        else:
            out.append([start, end, peak, level(peak), first, last, 1])

    for k in range(len(hz)):
        if firing[k] and open_ is None:
            first = max(0, k - c.bucket_keep + 1)
            open_ = (x[first], rel[k], hz[first])
        elif firing[k]:
            open_ = (open_[0], max(open_[1], rel[k], key=abs), open_[2])
        elif open_ is not None:
            close(x[k], hz[k])
            open_ = None
    if open_ is not None:
        close(t_end, hz[-1])
    return out


def degradation(timed: DataFrame, ends: DataFrame, c: Config = ROBOT) -> DataFrame:
    """(keys, t_start, t_end, slope, severity, hz_start, hz_end, episodes) of drifting topics.

    A topic's buckets, one in ten seconds, are one group; its arrivals are not.
    """
    names = ["t_start", "t_end", "slope", "severity", "hz_start", "hz_end", "episodes"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        found = episodes(part.x.to_numpy(), part.hz.to_numpy(), part.base_hz.to_numpy(float), float(part.end_t.iloc[0]), c)
        out = pd.DataFrame(found, columns=names).astype({"severity": int, "episodes": int})
        for k in reversed(KEYS):
            out.insert(0, k, part[k].iloc[0])
        return out

    rows = rate_buckets(timed, c).join(ends.select("mission_id", F.col("t_end").alias("end_t")), "mission_id")
    return rows.groupBy(*KEYS).applyInPandas(run, "mission_id string, topic string, t_start double, t_end double, slope double, severity int, hz_start double, hz_end double, episodes int")
