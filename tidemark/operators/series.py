"""Numeric series: resampling, summaries, outliers, change points, correlation, comparison, trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def resample(samples: DataFrame, keys: list[str], bin_s: float) -> DataFrame:
    """(keys, bin, centre, mean, n): tumbling means from the first sample; empty bins are null, never interpolated."""
    span = samples.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    span = span.withColumn("_n", F.greatest(F.lit(1), F.ceil((F.col("_t1") - F.col("_t0")) / bin_s)).cast("long"))
    filled = samples.join(span, keys).groupBy(*keys, F.least(F.floor((F.col("t") - F.col("_t0")) / bin_s), F.col("_n") - 1).alias("bin")).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    grid = span.select(*keys, "_t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin"))
    out = grid.join(filled, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("_t0") + (F.col("bin") + 0.5) * bin_s).alias("centre"), "mean", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def empty_runs(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_bin, last_bin) of runs of empty bins."""
    rows = bins.where("n = 0").withColumn("_g", F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin")))
    return rows.groupBy(*keys, "_g").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")).drop("_g")


def describe(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Count, extremes, mean, sample deviation and exact percentiles of finite values."""
    finite = samples.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    p = F.percentile("v", F.array(*map(F.lit, PERCENTILES)))
    out = finite.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), p.alias("_p"))
    return out.select("*", *[F.col("_p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(PERCENTILES)]).drop("_p")


def outliers_zscore(samples: DataFrame, keys: list[str], k: float) -> DataFrame:
    s = samples.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("v").alias("c")).where("c >= 3 and sd > 0")
    z = (F.col("v") - F.col("m")) / F.col("sd")
    return samples.join(s, keys).withColumn("score", F.abs(z)).where(F.col("score") > k).drop("m", "sd", "c")


def outliers_iqr(samples: DataFrame, keys: list[str], k: float) -> DataFrame:
    s = samples.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("v").alias("c")).where("c >= 4")
    iqr = F.col("q")[2] - F.col("q")[0]
    out = samples.join(s, keys).where(((F.col("v") < F.col("q")[0] - k * iqr) | (F.col("v") > F.col("q")[2] + k * iqr)) & (iqr > 0))
    return out.withColumn("score", F.abs(F.col("v") - F.col("q")[1]) / iqr).drop("q", "c")


def rolling_mad(v: np.ndarray, window: int) -> np.ndarray:
    """Robust z-scores against the median of a centred window; the ends are padded with the end values; 0 where MAD is 0."""
    h, out = window // 2, np.zeros(len(v))
    padded = np.concatenate([np.repeat(v[:1], h), v, np.repeat(v[-1:], h)])
    for at in range(0, len(v), 20_000):
        w = np.lib.stride_tricks.sliding_window_view(padded[at : at + 20_000 + 2 * h], window)
        med = np.median(w, axis=1)
        mad = np.median(np.abs(w - med[:, None]), axis=1)
        x = v[at : at + 20_000]
        np.divide(np.abs(x - med), 1.4826 * mad, out=out[at : at + 20_000], where=mad > 0)
    return out


def outliers_mad(samples: DataFrame, keys: list[str], k: float, window: int = 101) -> DataFrame:
    """(keys, seq, score) of rolling robust z-scores over k; a series is one group.

    The window shrinks to a shorter series, to five values at least; series of fewer have no outliers.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["us", "seq"], ignore_index=True)
        v = part.v.to_numpy(float)
        n = len(v)
        part["score"] = rolling_mad(v, max(5, min(window, n if n % 2 else n - 1))) if n >= 5 else 0.0
        return part[part.score > k][[*keys, "seq", "score"]]

    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in [*keys, "seq"])
    return samples.select(*keys, "us", "seq", "v").where("v is not null").groupBy(*keys).applyInPandas(run, f"{kinds}, score double")


def first_cut(samples: DataFrame, keys: list[str], least: int = 20, order: tuple[str, ...] = ("us", "seq")) -> DataFrame:
    """(keys, cut, gain): the split of a series that lowers squared error most; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    rows = samples.withColumn("i", F.row_number().over(w)).withColumn("s", F.sum("v").over(run)).withColumn("n", F.count("*").over(whole)).withColumn("all", F.sum("v").over(whole))
    gain = F.col("s") * F.col("s") / F.col("i") + (F.col("all") - F.col("s")) * (F.col("all") - F.col("s")) / (F.col("n") - F.col("i")) - F.col("all") * F.col("all") / F.col("n")
    rows = rows.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least)).withColumn("gain", F.round(gain, 4))
    best = rows.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("g"), "i")).alias("b"))
    return best.select(*keys, F.col("b.i").alias("cut"), (-F.col("b.g")).alias("gain"))


def all_cuts(values: np.ndarray, least: int = 20, most: int = 5, share: float = 0.0) -> list[int]:
    """Greedy binary segmentation: positions of up to so many cuts, each worth more than a share of all squared error."""
    total = ((values - values.mean()) ** 2).sum() if len(values) else 0.0
    cuts: list[int] = []
    for _ in range(most):
        best = (share * total, -1)
        edges = [0, *sorted(cuts), len(values)]
        for a, b in zip(edges, edges[1:], strict=False):
            x = values[a:b]
            if len(x) < 2 * least:
                continue
            i = np.arange(1, len(x))
            s = np.cumsum(x)[:-1]
            g = (s * s / i + (x.sum() - s) ** 2 / (len(x) - i) - x.sum() ** 2 / len(x))[least - 1 : len(x) - least]
            j = int(np.argmax(g))
            if g[j] > best[0]:
                best = (float(g[j]), a + least + j)
        if best[1] < 0:
            break
        cuts.append(best[1])
    return sorted(cuts)


def changepoints(samples: DataFrame, keys: list[str], least: int = 20, most: int = 5) -> DataFrame:
    """(keys, cut, mean_before, mean_after, shift) of every cut; a series is one group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values(["us", "seq"]).v.to_numpy(float)
        cuts = all_cuts(v, least, most)
        edges = [0, *cuts, len(v)]
        rows = [(c, v[a:c].mean(), v[c:b].mean()) for a, c, b in zip(edges, edges[1:], edges[2:], strict=False)]
        out = pd.DataFrame(rows, columns=["cut", "mean_before", "mean_after"])
        out["shift"] = out.mean_after - out.mean_before
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    return samples.groupBy(*keys).applyInPandas(run, f"{kinds}, cut long, mean_before double, mean_after double, shift double")


#: Positions of a series that one group correlates.
BLOCK = 100_000


def cross_correlation(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(lag, r, n) for two resampled series(i, v), by position; gaps hold the mean; the denominator is that of lag 0.

    Blocks of positions meet with what follows and precedes them by so many, and add up their products for all lags.
    """
    n = a.agg(F.max("i").alias("_a")).crossJoin(b.agg(F.max("i").alias("_b"))).select(F.least("_a", "_b").alias("_n"))  # one row

    def centred(d: DataFrame) -> DataFrame:
        d = d.crossJoin(F.broadcast(n)).where("i <= _n").drop("_n")
        return d.crossJoin(F.broadcast(d.agg(F.avg("v").alias("m")))).select(F.col("i").cast("long").alias("i"), (F.coalesce("v", "m") - F.col("m")).alias("x"))

    x, y = centred(a), centred(b)
    block = lambda i: F.floor(i / BLOCK)
    x = x.select(block(F.col("i")).alias("block"), F.lit(0).alias("side"), "i", "x")
    y = y.select(F.explode(F.array_distinct(F.array(block(F.col("i") - most), block(F.col("i")), block(F.col("i") + most)))).alias("block"), F.lit(1).alias("side"), "i", "x")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part.block.iloc[0]) * BLOCK - most
        one, other = np.zeros((2, BLOCK + 2 * most))
        for side, to in ((0, one), (1, other)):
            some = part[part.side == side]
            to[(some.i - at).to_numpy()] = some.x.to_numpy()
        mine = other[most : most + BLOCK]
        own = one[most : most + BLOCK]
        lags = np.arange(-most, most + 1)
        s = [own @ other[most + k : most + k + BLOCK] for k in lags]
        return pd.DataFrame({"lag": lags, "s": s, "px": own @ own, "py": mine @ mine, "n": int((part.side == 0).sum())})

    out = x.unionByName(y).groupBy("block").applyInPandas(run, "lag long, s double, px double, py double, n long")
    out = out.groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("s", "px", "py", "n")])
    return out.select("lag", F.when(F.col("px") * F.col("py") > 0, F.col("s") / F.sqrt(F.col("px") * F.col("py"))).otherwise(0.0).alias("r"), "n")


def correlation(a: DataFrame, b: DataFrame, bin_s: float, most_s: float = 5.0) -> DataFrame:
    """(lag_s, r, relation): the lag of the strongest correlation, and who leads; nothing below eight bins in common.

    relation is none below 0.3, together without a lag, else a leads or b leads. Of equals the smallest lag counts.
    """
    rows = cross_correlation(a, b, int(most_s / bin_s)).where(F.abs("lag") <= F.least(F.lit(int(most_s / bin_s)), F.col("n") - 2))
    best = rows.agg(F.min_by(F.struct("lag", "r", "n"), F.struct((-F.round(F.abs("r"), 9)).alias("s"), "lag")).alias("b"))
    ok = F.col("b.n") >= 8
    lag, r = F.when(ok, F.col("b.lag") * bin_s).otherwise(0.0), F.when(ok, F.col("b.r")).otherwise(0.0)
    relation = F.when(F.abs(r) < 0.3, "none").when(F.abs(lag) < bin_s, "together").when(lag > 0, "a leads").otherwise("b leads")
    return best.select(lag.alias("lag_s"), r.alias("r"), relation.alias("relation"))


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Difference of means, b - a, over the pooled deviation; 0 where undefined."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m2 - m1) / pooled).otherwise(0.0)


def two_groups(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, var of a and b, d, magnitude) for samples(keys, side, v) with sides a and b."""
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("v")))
    out = samples.groupBy(*keys).agg(*[side(f, s).alias(f"{name}_{s}") for s in "ab" for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    d = cohens_d(*[F.col(f"{x}_{s}") for s in "ab" for x in ("n", "mean", "var")])
    size = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    return out.withColumn("d", d).withColumn("magnitude", size)


def ks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ks): the largest distance of the distributions of sides a and b."""
    is_a = F.when(F.col("side") == "a", 1).otherwise(0)
    counts = samples.groupBy(*keys, "v").agg(F.sum(is_a).alias("a"), F.sum(1 - is_a).alias("b"))
    w, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(w) - F.sum("b").over(run) / F.sum("b").over(w))
    return counts.select(*keys, gap.alias("g")).groupBy(*keys).agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("ks"))


def _chunk(alpha: float) -> int:
    """Rows after which what came before has a weight of about 1e-5."""
    return max(2, math.ceil(math.log(1e-5) / math.log1p(-alpha))) if alpha < 1 else 2


def _terms(samples: DataFrame, keys: list[str], alpha: float, value: str, order: tuple[str, ...]) -> DataFrame:
    """Rows with _c, the chunk, _r, the place in it, and _term, a value with the weight it has at the chunk's beginning."""
    size, keep = _chunk(alpha), 1 - alpha
    rows = samples.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    rows = rows.withColumn("_c", F.floor(F.col("_i") / size)).withColumn("_r", F.col("_i") % size)
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    return rows.withColumn("_term", weight * F.col(value) * F.pow(F.lit(keep), -F.col("_r")))


def ewma_rows(samples: DataFrame, keys: list[str], alpha: float, value: str = "dt", order: tuple[str, ...] = ("us", "seq")) -> DataFrame:
    """samples with ewma, the average so far, seeded with the first value; alpha is below 1.

    A chunk's sum needs its own rows only, and four chunks back nothing weighs any more, so no group is gathered.
    """
    size, keep = _chunk(alpha), 1 - alpha
    own = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _terms(samples, keys, alpha, value, order).withColumn("_own", F.sum("_term").over(own) * F.pow(F.lit(keep), F.col("_r")))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total, last = F.col("_own"), F.col("_own")
    for m in range(4):
        name = f"_p{m}"
        rows = rows.withColumn(name, F.last(F.when(F.col("_r") == size - 1, last), True).over(before))
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_r") + 1 + m * size)
        last = F.col(name)
    return rows.withColumn("ewma", total).drop("_i", "_c", "_r", "_term", "_own", *[f"_p{m}" for m in range(4)])


def ewma(samples: DataFrame, keys: list[str], alpha: float, value: str = "dt", order: tuple[str, ...] = ("us", "seq")) -> DataFrame:
    """(keys, ewma): the last value of an average seeded with the first value; alpha is below 1."""
    size, keep = _chunk(alpha), 1 - alpha
    chunks = _terms(samples, keys, alpha, value, order).groupBy(*keys, "_c").agg(F.sum("_term").alias("_s"), F.max("_r").alias("_l"))
    chunks = chunks.withColumn("_s", F.col("_s") * F.pow(F.lit(keep), F.col("_l")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"))
    chunks = chunks.withColumn("_b", F.row_number().over(w) - 1).withColumn("_first", F.first("_l").over(w)).where("_b < 5")
    back = F.when(F.col("_b") == 0, 1.0).otherwise(F.pow(F.lit(keep), F.col("_first") + 1 + (F.col("_b") - 1) * size))
    return chunks.groupBy(*keys).agg(F.sum(F.col("_s") * back).alias("ewma"))


def slopes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, slope, tau, significant) of points(keys, x, y): Theil-Sen slope and Kendall's test at 5 %.

    Every pair within a key is looked at; a key has a few points, such as days or missions.
    """
    a, b = points.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1")), points.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = a.join(b, keys).where("x1 < x2")
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    s = F.sign(F.col("y2") - F.col("y1"))
    out = pairs.groupBy(*keys).agg(F.percentile((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), 0.5).alias("slope"), F.sum(s).alias("s"), F.sum(F.abs(s)).alias("d")).join(n, keys)
    tau = F.when((F.col("n") >= 4) & (F.col("d") > 0), F.col("s") / F.col("d")).otherwise(0.0)
    z = F.abs("tau") / F.sqrt(2.0 * (2 * F.col("n") + 5) / (9.0 * F.col("n") * (F.col("n") - 1)))
    return out.withColumn("tau", tau).withColumn("significant", (F.col("n") >= 4) & (z > 1.959963984540054)).select(*keys, "n", "slope", "tau", "significant")


def dtw(a: np.ndarray, b: np.ndarray, band: int = 20) -> float:
    """Banded dynamic time warping of two standardised series."""
    def z(x: np.ndarray) -> np.ndarray:
        return (x - x.mean()) / (x.std() or 1.0)

    a, b = z(np.asarray(a, float)), z(np.asarray(b, float))
    n, m = len(a), len(b)
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        new = np.full(m + 1, np.inf)
        lo, hi = max(1, i - band), min(m, i + band)
        for j in range(lo, hi + 1):
            new[j] = (a[i - 1] - b[j - 1]) ** 2 + min(row[j], row[j - 1], new[j - 1])
        row = new
    return math.sqrt(row[m] / max(n, m)) if np.isfinite(row[m]) else math.inf


def dtw_rank(series: DataFrame, key: str, target, band: int = 20) -> DataFrame:
    """(key, distance) of series(key, i, v) from the one with the key target, nearest first."""
    goal = [r[0] for r in series.where(F.col(key) == target).orderBy("i").select("v").collect()]  # one series

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [part[key].iloc[0]], "distance": [dtw(np.array(goal), part.sort_values("i").v.to_numpy(), band)]})

    others = series.where(F.col(key) != target)
    return others.groupBy(key).applyInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, distance double").orderBy("distance", key)
