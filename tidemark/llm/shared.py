"""What several training-data operators need: reading tables, cutting lineage, union of links."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


#: So that Python workers find the package from any folder.
WORKERS = {"PYTHONPATH": ROOT, "MALLOC_ARENA_MAX": "2"}


def trim() -> None:
    """Gives a worker's free memory back; workers live on from stage to stage."""
    with suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def uncollected(f: Callable, *args):
    """f(*args) without the collector, which would go through all its lists and tuples again and again; f makes no cycles of them."""
    gc.disable()
    try:
        return f(*args)
    finally:
        gc.enable()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM has gone already
            return
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone already
            return


atexit.register(_remove)


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: cuts lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that were stored inside at its end, but for those that the function it gives has stored."""
    mine, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        kept.append(_written[-1])
        return out

    yield keep
    gone = [x for x in _written[mine:] if x not in kept]
    _written[mine:] = kept
    for _, path in gone:
        _delete(spark, path)
    release(spark)


def slices(batches, size: int, column: int = 1):
    """Record batches cut so that the strings of a column have so many bytes at most, unless one alone has more."""
    trim()
    for b in batches:
        texts, at, held = b.column(column), 0, 0
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, held + size, side="right")))
            yield b.slice(at, end - at)
            at, held = end, int(ends[end - 1])
    trim()


def parts(rows: int, each: int, least: int = 1) -> int:
    """Partitions for so many rows; grows with the input without a cap."""
    return max(least, -(-max(rows, 0) // each))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as a spanning star forest (node, smallest node of its tree), roots left out."""
    if not len(a):
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        m = p != q
        if not m.any():
            break
        x, y, p, q = x[m], y[m], p[m], q[m]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
    m = up != np.arange(len(nodes))
    return nodes[m], nodes[up[m]]


def _local(batches):
    import pandas as pd

    found = [b for b in batches if len(b)]
    if found:
        all_ = pd.concat(found)
        a, b = forest(all_.a.to_numpy(), all_.b.to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame, forests: bool = False) -> DataFrame:
    """(node, component) for every node of links(a long, b long); component is the smallest node reachable.

    Links are made a forest in each partition first, unless forests says that they are.

    Rounds of contraction: every node takes the smallest of its neighbours' neighbours as its label, links move to
    the labels, loops and repeats go. Each round is joins and partially aggregated sums, so that a node with very
    many links is spread by adaptive skew joins; the lineage is cut by a stored table per round. No links: no rows.
    """
    spark = links.sparkSession
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = stored(links if forests else links.mapInPandas(_local, "a long, b long"))
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        up = stored(up)
        over = up.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        label = stored(up.join(over, up["up"] == over["n2"]).select("node", F.col("up2").alias("label")))
        steps.append(label)
        la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
        links = stored(links.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.toDF("label", "last")
        out = step.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return out.toDF("node", "component")


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished rounds, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by key: later groupings by key shuffle nothing of it."""
    spark = df.sparkSession
    name = f"tidemark_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _written.append((spark, path))
    _tables.append((spark, name))
    return spark.table(name)
