"""Best-fit packing planned over a histogram of lengths.

Counts of each length go to the driver (capacity + 1 numbers at most); best-fit decreasing runs over the counts and
yields ranges "documents of length l with ranks r..r+n take offset o in sequences s..s+n". Pieces find their range by
their rank within their length. Ranks come from salted windows, so that a length that a third of all pieces share is
spread over many tasks.
Null texts count as empty; an empty text is the separator alone; repeated rows are packed one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import parts, slices, stored

CAPACITY, SEPARATOR = 2048, 0
#: Pieces that share a salt, and bytes of text that are encoded at once.
SALT_ROWS, TOGETHER = 50_000, 2_000_000


@cache
def encoder(path: str):
    """A function from text to ids for a tokenizers file, without the special tokens that a file adds around a text.

    A special token's string within a text is that token, as in the library. A byte-level BPE whose ids follow its
    merges is run by tiktoken, which gives the same ids sooner.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = spec["model"].get("type", "BPE") == "BPE" and not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
    added = spec.get("added_tokens", [])
    if plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        import re

        import tiktoken

        # byte-level files write byte b as the character b where that prints, else as the next one from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in added}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged == sorted(merged):
            ranks = {bytes(char[c] for c in k): v for k, v in vocab.items()}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            ordinary = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if not special:
                return ordinary
            within = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

            def encode(text: str) -> list[int]:
                cut = within.split(text)
                if len(cut) == 1:
                    return ordinary(text)
                return [i for k, part in enumerate(cut) for i in ([special[part]] if k % 2 else ordinary(part))]

            return encode
    tok = Tokenizer.from_file(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and the separator, cut where longer than capacity.

    ids are little-endian unsigned 32-bit numbers in a binary value.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode = encoder(tokenizer)
        for part in slices(batches, TOGETHER):
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), separator], "<u4")
                rows += [(doc, i, s, n, ids[s : s + n].tobytes()) for i, (s, n) in enumerate(cuts(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, n, first sequence, offset) and the number of sequences, by best-fit decreasing."""
    rows, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # by what is free: runs (first sequence, n)
    free: list[int] = []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(free, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo and (at := bisect_left(free, length)) < len(free):
            left = free[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], free[at]
            took = min(n, todo)
            rows.append((length, rank, took, first, capacity - left))
            put(left, first + took, n - took)
            put(left - length, first, took)
            rank, todo = rank + took, todo - took
        each = capacity // length
        for n, k in ((todo // each, each), (1, todo % each)):
            if n and k:
                rows += [(length, rank + i * n, n, opened, i * length) for i in range(k)]
                put(capacity - k * length, opened, n)
                rank, opened = rank + n * k, opened + n
    return np.array(rows, np.int64).reshape(-1, 5), opened


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """lengths(doc_id, piece, length, ...) with sequence_id and offset; length is 1 to capacity.

    The plan sent to the executors depends on capacity alone: a few rows for each length and each fill level.
    """
    counts = {r[0]: r[1] for r in lengths.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    salts = parts(sum(counts.values()), SALT_ROWS, 16)
    salted = lengths.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*lengths.columns, "_rank")
    order = np.lexsort((rows[:, 1], rows[:, 0])) if len(rows) else []
    rows = rows[order]

    def run(batches):
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            out = b.drop_columns(["_rank"]) if hasattr(b, "drop_columns") else b.select([n for n in b.schema.names if n != "_rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=[*out.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for docs(doc_id, text)."""
    slim = pieces(docs, tokenizer, capacity, separator).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(slim), capacity)
