"""Frames: the nearest one to each target time, point-cloud summaries, and raw images as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Channels and bytes of raw encodings.
ENCODINGS = {"rgb8": (3, 1), "bgr8": (3, 1), "rgba8": (4, 1), "bgra8": (4, 1), "mono8": (1, 1), "8UC1": (1, 1), "mono16": (1, 2)}


def nearest_frames(frames: DataFrame, targets: DataFrame, keys: list[str], within: float) -> DataFrame:
    """(keys, target, seq, off_s): for each target time the nearest of frames(keys, us, seq, t) that is near enough.

    Targets are a few times a caller names; they meet frames by buckets of time.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * within)).cast("long")
    t = targets.select("target", F.explode(F.array(cell("target") - 1, cell("target"), cell("target") + 1)).alias("_cell"))
    near = frames.withColumn("_cell", cell("t")).join(t, "_cell").withColumn("off_s", F.abs(F.col("t") - F.col("target"))).where(F.col("off_s") <= within)
    return near.groupBy(*keys, "target").agg(F.min_by("seq", F.struct("off_s", "us", "seq")).alias("seq"), F.min("off_s").alias("off_s"))


def cloud_summary(clouds: DataFrame, keys: list[str], most: int | None = 200) -> DataFrame:
    """(keys, n, mean, least and most points, share of empty clouds, mean bytes, verdict) of clouds(keys, us, seq, points, bytes).

    Of each topic the first so many clouds count; all of them where most is None.
    """
    from pyspark.sql import Window

    some = clouds if most is None else clouds.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("us", "seq"))).where(F.col("_r") <= most)
    out = some.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("points").alias("mean_points"), F.min("points").alias("min_points"), F.max("points").alias("max_points"), F.avg((F.col("points") == 0).cast("double")).alias("empty_share"), F.avg("bytes").alias("mean_bytes"))
    return out.withColumn("verdict", F.when(F.col("empty_share") > 0.1, "empty_clouds").when(F.col("min_points") < 0.5 * F.col("mean_points"), "uneven").otherwise("steady"))


def raw_image(data: bytes, height: int, width: int, encoding: str) -> np.ndarray:
    """The pixels of a raw image, channels in red-green-blue order."""
    channels, size = ENCODINGS[encoding]
    out = np.frombuffer(data, np.uint8 if size == 1 else np.dtype("<u2"), height * width * channels).reshape(height, width, channels)
    return out[..., [2, 1, 0, *range(3, channels)]] if encoding.startswith("bgr") else out


def contact_sheet(images: list[np.ndarray], columns: int = 4) -> np.ndarray:
    """Images of one shape in a grid of up to so many columns."""
    columns = min(columns, len(images))
    blank = np.zeros_like(images[0])
    rows = [images[i : i + columns] + [blank] * (columns - len(images[i : i + columns])) for i in range(0, len(images), columns)]
    return np.concatenate([np.concatenate(r, axis=1) for r in rows], axis=0)
