"""Questions across recordings: cohorts, rankings, trends, similarity, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import dtw_rank, slopes


def upserted(current: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both by name; of equal keys the one with the highest version stays, the new one of equals."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")


def replaced(current: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """current without the rows of keys(key), and new: deletes and inserts per recording."""
    return current.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def unindexed(found: DataFrame, indexed: DataFrame, key: str, version: int) -> DataFrame:
    """found rows that are not indexed at this version."""
    return found.join(indexed.where(F.col("version") == version).select(key), key, "left_anti")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def search(rows: DataFrame, key: str, own: list[str], others: list[tuple[DataFrame, str]], text: str) -> DataFrame:
    """rows where a column holds the text, or a row of another table with the same key does; case does not matter."""
    needle = text.lower()
    match = lambda c: F.contains(F.lower(F.col(c)), F.lit(needle))
    hit = rows.where(F.array_contains(F.array(*[F.coalesce(match(c), F.lit(False)) for c in own]), True)).select(key)
    for other, column in others:
        hit = hit.union(other.where(match(column)).select(key))
    return rows.join(hit.distinct(), key, "left_semi")


def cohorts(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, std, median); std is 0 below two rows."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.percentile(value, 0.5).alias("median"))


def trends(points: DataFrame, keys: list[str], spread: float | None = None) -> DataFrame:
    """points(keys, x, y) as improving, worsening or steady: the move over all points must exceed their MAD."""
    mid = points.groupBy(*keys).agg(F.percentile("y", 0.5).alias("m"))
    mad = points.join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("y") - F.col("m")), 0.5).alias("mad"))
    out = slopes(points, keys).join(mad, keys)
    moved = F.abs("slope") * (F.col("n") - 1)
    return out.withColumn("trend", F.when((F.col("n") < 3) | (moved <= F.col("mad")), "steady").when(F.col("slope") > 0, "improving").otherwise("worsening"))


def standardised(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean over the population deviation; a deviation of 0 counts as 1."""
    stats = features.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = features.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def similarity(features: DataFrame, key: str, columns: list[str], topics: str, templates: str, target) -> DataFrame:
    """(key, similarity) to the target: half from feature distance, the rest from topics and templates in common."""
    z = standardised(features, columns)
    goal = z.where(F.col(key) == target).select(*[F.col(c).alias(f"_g_{c}") for c in columns], F.col(topics).alias("_gt"), F.col(templates).alias("_gp"))
    both = z.where(F.col(key) != target).crossJoin(F.broadcast(goal))  # one row
    d = F.sqrt(sum(((F.col(c) - F.col(f"_g_{c}")) ** 2 for c in columns), F.lit(0.0)))
    score = 0.5 * F.exp(-d / F.sqrt(F.lit(float(len(columns))))) + 0.3 * jaccard(F.col(topics), F.col("_gt")) + 0.2 * jaccard(F.col(templates), F.col("_gp"))
    return both.select(key, score.alias("similarity"))


def preflight(history: DataFrame, unit: str, lookback: int = 5) -> DataFrame:
    """(unit, n, last_score, compromised, slope, decision) of history(unit, x, score), oldest first by x.

    block: the last score under 60 or two of the last ones compromised; warn: under 85, losing over two points a
    recording, or fewer than three recordings; else go.
    """
    w = Window.partitionBy(unit).orderBy(F.desc("x"))
    last = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lookback)
    one = last.groupBy(unit).agg(F.count("*").alias("n"), F.max_by("score", "x").alias("last_score"), F.sum((F.col("score") < 60).cast("long")).alias("compromised"))
    trend = slopes(last.select(unit, F.col("x").cast("double").alias("x"), F.col("score").alias("y")), [unit]).select(unit, "slope")
    out = one.join(trend, unit, "left")
    block = (F.col("last_score") < 60) | (F.col("compromised") >= 2)
    warn = (F.col("last_score") < 85) | (F.coalesce("slope", F.lit(0.0)) < -2) | (F.col("n") < 3)
    return out.withColumn("decision", F.when(block, "block").when(warn, "warn").otherwise("go"))


def fingerprint(history: DataFrame, unit: str, metrics: list[str], keep: int = 20, lookback: int = 50) -> DataFrame:
    """(unit, metric, slope, weight) of metrics that get worse over the last recordings, by how fast against their spread."""
    last = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("x")))
    rows = history.withColumn("_l", last).where(F.col("_l") <= lookback)
    rows = rows.select(unit, F.col("x").cast("double").alias("x"), F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "y"))
    out = trends(rows, [unit, "metric"]).where("trend = 'worsening'").withColumn("weight", F.abs("slope") / F.greatest("mad", F.lit(1e-9)))
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("weight"), "metric"))
    return out.withColumn("_r", rank).where(F.col("_r") <= keep).select(unit, "metric", "slope", "weight")


def precedents(events: DataFrame, recordings: DataFrame, key: str, unit: str, kind: str, most: int = 20) -> DataFrame:
    """The newest events(key, kind, t) of a kind with their unit."""
    return events.where(F.col("kind") == kind).join(recordings, key).orderBy(F.desc("t"), key).limit(most)


def affected(found: DataFrame, unit: str) -> DataFrame:
    """(occurrences, units, fleet_wide) of precedents: whether more units than one have seen it."""
    units = F.array_sort(F.collect_set(unit))
    return found.agg(F.count("*").alias("occurrences"), units.alias("units"), (F.size(units) > 1).alias("fleet_wide"))


#: What recordings rank by: a column of theirs, or an aggregate over their topics or events, 0 where they have none.
METRICS = {
    "health_score": ("recordings", F.max, "health_score"),
    "duration_s": ("recordings", F.max, "duration_s"),
    "message_count": ("recordings", F.max, "message_count"),
    "size_bytes": ("recordings", F.max, "size_bytes"),
    "gap_count": ("topics", F.sum, "gap_count"),
    "estimated_dropped": ("topics", F.sum, "estimated_dropped"),
    "max_jitter_cv": ("topics", F.max, "jitter_cv"),
    "event_count": ("events", F.count, "severity"),
    "critical_events": ("events", lambda c: F.sum((F.col(c) >= 4).cast("long")), "severity"),
}


def ranked(metric: str, recordings: DataFrame, topics: DataFrame, events: DataFrame, key: str, ascending: bool = False, most: int = 10) -> DataFrame:
    """(metric, rank, key, value): the first recordings by one of METRICS; ties go by key."""
    table, how, column = METRICS[metric]
    if table == "recordings":
        rows = recordings.select(key, F.col(column).cast("double").alias("value"))
    else:
        of = {"topics": topics, "events": events}[table].groupBy(key).agg(how(column).cast("double").alias("value"))
        rows = recordings.select(key).join(of, key, "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"))
    first = rows.orderBy(F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value"), key).limit(most)
    w = Window.orderBy(F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value"), key)  # over the first few rows
    return first.select(F.lit(metric).alias("metric"), F.row_number().over(w).alias("rank"), key, "value")


def anchors(samples: DataFrame, key: str, signals: list[str], least: float = 0.05) -> DataFrame:
    """(key, t, source): when a recording began to move, the first sample beyond least of the first signal that has one."""
    place = F.array_position(F.array(*map(F.lit, signals)), F.col("signal"))
    moving = samples.where(F.col("signal").isin(signals) & (F.abs("v") > least)).groupBy(key, "signal", place.alias("_p")).agg(F.min("t").alias("t"))
    return moving.groupBy(key).agg(F.min_by("t", "_p").alias("t"), F.min_by("signal", "_p").alias("source"))


def aligned(samples: DataFrame, key: str, mode: str, durations: DataFrame | None = None, moves: DataFrame | None = None) -> DataFrame:
    """samples(key, t) with t as it is (absolute), as a share of the recording (progress), or since its anchor (event).

    durations(key, duration_s) and moves(key, t) come from the catalog and anchors(); without an anchor t stays.
    """
    if mode == "progress":
        out = samples.join(durations.select(key, "duration_s"), key)
        return out.withColumn("t", F.col("t") / F.greatest("duration_s", F.lit(1e-9))).drop("duration_s")
    if mode == "event":
        out = samples.join(moves.select(key, F.col("t").alias("_m")), key, "left")
        return out.withColumn("t", F.col("t") - F.coalesce("_m", F.lit(0.0))).drop("_m")
    if mode != "absolute":
        raise ValueError(mode)
    return samples


def most_similar(features: DataFrame, key: str, columns: list[str], topics: str, templates: str, target, series_: DataFrame | None = None, top: int = 5, band: int = 20) -> DataFrame:
    """(key, similarity, distance, why): recordings like the target; time warping of series_(key, i, v) ranks a shortlist.

    The shortlist are the first by similarity, three times as many as are asked for and ten at least.
    """
    both = similarity(features, key, columns, topics, templates, target)
    goal = features.where(F.col(key) == target).select(F.col(topics).alias("_gt"), F.col(templates).alias("_gp"))
    short = both.orderBy(F.desc("similarity"), key).limit(max(3 * top, 10)).join(features.select(key, topics, templates), key).crossJoin(F.broadcast(goal))  # one row
    if series_ is not None:
        near = series_.join(short.select(key).unionByName(features.where(F.col(key) == target).select(key)), key, "left_semi")
        short = short.join(dtw_rank(near, key, target, band), key, "left")
    else:
        short = short.withColumn("distance", F.lit(None).cast("double"))
    why = F.concat_ws(", ", F.when(jaccard(F.col(topics), F.col("_gt")) > 0.9, "same topics"), F.when(jaccard(F.col(templates), F.col("_gp")) > 0.5, "similar log patterns"), F.when(F.col("distance").isNotNull(), F.format_string("distance %.3f", "distance")))
    out = short.select(key, "similarity", "distance", F.when(why == "", "closest of all").otherwise(why).alias("why"))
    return out.orderBy(F.asc_nulls_last("distance"), F.desc("similarity"), key).limit(top)
