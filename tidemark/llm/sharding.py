"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.packing import encoder
from tidemark.llm.shared import parts, stored

#: Groups with a larger share of the bytes, tokens or rows are split, into portions of about half that share.
WHOLE = 1 / 64
#: Rows of one window at most, on average; units that one task places; share from which on a unit is placed first.
WINDOW_ROWS, UNITS, FIRST = 50_000, 20_000, 1 / 4096
#: What bytes, tokens and rows weigh in the dot product.
WEIGHTS = (1.0, 0.5, 0.5)


def place(demand: np.ndarray, residual: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each unit: largest units first, each where demand . residual is highest; changes residual."""
    shards = len(residual)
    order = np.argsort(-demand.max(axis=1), kind="stable")
    at = np.roll(np.arange(shards), turn % shards)
    left, out, w = residual[at], np.empty(len(demand), np.int64), np.array(WEIGHTS)
    for i in order:
        s = int(np.argmax(left @ (demand[i] * w)))
        left[s] -= demand[i]
        out[i] = at[s]
    residual[at] = left
    return out


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) with tokens, how many ids a tokenizers file gives for the text."""

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            n = [len(encode(x.as_py() or "")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["doc_id", "text", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, tokens long")


def measured(docs: DataFrame, tokens=None) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, digest): size is the UTF-8 bytes of the text and 1.

    tokens is a column; without one, words count.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(t, F.lit(r"\S+")) if tokens is None else tokens
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))


def assign(slim: DataFrame, shards: int) -> DataFrame:
    """slim(doc_id, size, tokens, digest, ...) with shard int and slot long.

    Rows with equal digests form a group and stay in one shard, unless its share is so large (WHOLE) that shards of near
    equal bytes need it split; portions are fixed by doc_id. Units of a noticeable share (at most 3 / FIRST of them) are
    placed in one task; all others are dealt to tasks by hash, and each task fills an equal part of what is left of every
    shard. Slots count from 0 in each shard without gaps.
    An empty table gives an empty result; repeated rows count one by one and take slots of their own.
    """
    total = slim.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    totals = np.array([max(1, x or 0) for x in total], float)
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = F.greatest(F.col("size") / totals[0], F.col("tokens") / totals[1], F.col("n") / totals[2])
    large = slim.groupBy("digest").agg(*sums).where((F.col("n") > 1) & ((share > WHOLE) | (F.col("n") > WINDOW_ROWS)))
    large = large.withColumn("_k", F.when(share > WHOLE, F.ceil(share * (2 / WHOLE))).otherwise(F.lit(1)).cast("long"))
    large = stored(large.select(F.col("digest").alias("_d"), "_k", F.ceil(F.col("n") / F.col("_k") / WINDOW_ROWS).cast("long").alias("_m")))
    slim = slim.join(large, slim["digest"] == large["_d"], "left").drop("_d").withColumn("_portion", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_k")), F.lit(0).cast("long")))
    slim = slim.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("_m")), F.lit(0).cast("long"))).drop("_k")
    units = slim.groupBy("digest", "_portion").agg(*sums)
    units = stored(units.withColumn("first", share > FIRST))
    buckets = parts(units.count(), UNITS)
    free = np.ones((shards, 3))
    scale = shards / totals

    def run(free: np.ndarray, scale: np.ndarray):
        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["digest", "_portion"], ignore_index=True)
            shard = place(part[["size", "tokens", "n"]].to_numpy(float) * scale, free.copy(), int(part.bucket[0]))
            n = part.n.to_numpy()
            before = np.zeros(len(n), np.int64)
            for s in range(shards):
                m = shard == s
                before[m] = np.cumsum(n[m]) - n[m]
            return pd.DataFrame({"digest": part.digest, "portion": part._portion, "shard": shard, "bucket": part.bucket, "before": before, "n": n, "size": part["size"], "tokens": part.tokens})

        return one

    schema = "digest binary, portion long, shard int, bucket long, before long, n long, size long, tokens long"
    heavy = stored(units.where("first").withColumn("bucket", F.lit(-1).cast("long")).groupBy("bucket").applyInPandas(run(free, scale), schema))
    for s, a, b, c in heavy.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.sum("n")).collect():
        free[s] -= np.array([a, b, c], float) * scale
    light = units.where("not first").withColumn("bucket", F.pmod(F.xxhash64("digest", "_portion"), F.lit(buckets)).cast("long"))
    light = light.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run(free, scale * buckets), schema)
    placed = stored(heavy.union(light).drop("size", "tokens"))
    start = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    start = start.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    placed = stored(placed.join(start, ["shard", "bucket"]).select(F.col("digest").alias("_d"), F.col("portion").alias("_p"), "shard", (F.col("start") + F.col("before")).alias("_start")))
    # large units are ranked by salt, then by doc_id
    rank = F.row_number().over(Window.partitionBy("digest", "_portion", "_salt").orderBy("doc_id")) - 1
    salts = slim.where("_m > 1").groupBy("digest", "_portion", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("digest", "_portion").orderBy("_salt")) - F.col("_n")
    salts = stored(salts.withColumn("_before", before).select(F.col("digest").alias("_sd"), F.col("_portion").alias("_sp"), F.col("_salt").alias("_ss"), "_before"))
    out = slim.withColumn("_rank", rank).join(placed, (F.col("digest") == F.col("_d")) & (F.col("_portion") == F.col("_p")))
    out = out.join(salts, (F.col("digest") == F.col("_sd")) & (F.col("_portion") == F.col("_sp")) & (F.col("_salt") == F.col("_ss")), "left")
    out = out.withColumn("slot", (F.col("_start") + F.coalesce("_before", F.lit(0)) + F.col("_rank")).cast("long"))
    return out.drop("_d", "_p", "_m", "_portion", "_salt", "_rank", "_start", "_sd", "_sp", "_ss", "_before")


def shard_documents(docs: DataFrame, shards: int = 16, tokens=None) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, digest, shard, slot) for docs(doc_id, text); a null text has no bytes."""
    return assign(stored(measured(docs, tokens)), shards)
