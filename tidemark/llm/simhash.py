"""SimHash near-duplicates, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in three bits at most have a half that
differs in one bit at most, so they share one of that half's 32 one-wildcard variants. Distinct fingerprints meet by
equality of variants, are verified by Hamming distance in blocks, and links are united into components.
Nulls count as empty texts, an empty text has the fingerprint zero, which links like any other; repeated rows with
one doc_id stay as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, forest, parts, slices, stored, trim

SEED = 42
#: Variant entries (24 bytes each) that one group of the index holds.
ENTRIES = 1_000_000
#: Bytes of a row of entries, about: above half a megabyte the JVM gives each row regions of its heap of its own.
ROW = 1 << 18
#: Bytes of texts at a time.
CHUNK = 4_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    tokens = (text or "").encode().lower().split()  # for bytes: A-Z only, and the six ASCII white-space bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): fp is the fingerprint's two's complement."""

    def run(batches):
        for b in slices(batches, CHUNK):
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fp: np.ndarray, segments: int = 2) -> np.ndarray:
    """64 keys for each unsigned fingerprint: segment and wildcard in the upper bits, the segment without it below."""
    width = 64 // segments
    full = np.uint64((1 << width) - 1)
    part = np.stack([(fp >> np.uint64(width * i)) & full for i in range(segments)], 1)
    keep = ~(np.uint64(1) << np.arange(width, dtype=np.uint64)) & full
    tag = np.arange(64, dtype=np.uint64).reshape(segments, width) << np.uint64(width)
    return ((part[:, :, None] & keep[None, None, :]) | tag[None]).reshape(len(fp), 64)


#: Fingerprints of one key from which on they are cut again.
LONG = 512


def _met(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of equal keys, which are in order: a key's entries are compared with each other."""
    left, right, held = [], [], 0
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        left.append(node[hit])
        right.append(node[hit + step])
        held += len(hit)
        if held > 2_000_000:  # keep what is held bounded
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
        step += 1
    if not left:
        return node[:0], node[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def linked(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that share a key and differ in so many bits at most.

    Keys are those of variants() for two segments. A key that very many fingerprints share is cut again: they differ in
    three bits at most in the other half too, so they share a one-wildcard variant of one of its quarters; then no more
    than the other 17 bits tell those that meet apart, however many fingerprints there are.
    """
    order = np.argsort(keys, kind="stable")
    keys, fp, node = keys[order], fp[order], node[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(keys)])
    long = np.repeat(many > (LONG if bits <= 3 else len(keys)), many)
    a, b = _met(keys[~long], fp[~long], node[~long], bits)
    if long.any():
        run = np.repeat(np.arange(len(first), dtype=np.uint64), many)[long]
        keys, fp, node = keys[long], fp[long], node[long]
        other = np.where(keys >> np.uint64(37) == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))  # the half that the key does not hold
        for quarter in (0, 16):
            part = (other >> np.uint64(quarter)) & np.uint64(0xFFFF)
            for bit in range(16):
                key = run << np.uint64(16) | part & np.uint64(0xFFFF ^ 1 << bit)
                order = np.argsort(key, kind="stable")
                x, y = _met(key[order], fp[order], node[order], bits)
                a, b = forest(np.r_[a, x], np.r_[b, y])
    return a, b


def links(nodes: DataFrame, n: int, bits: int = 3) -> DataFrame:
    """(a, b): links between the distinct fingerprints nodes(fp long, node long); those of a partition are a forest.

    Entries go to their group's partition as they are, neither sorted nor gathered there by the JVM.
    """
    groups = parts(64 * n, ENTRIES)
    some = min(20_000, max(1, ROW * groups // (64 * 24)))

    def emit(batches):
        trim()
        for b in batches:
            all_, nodes_ = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(all_), some):
                f, k = all_[at : at + some], nodes_[at : at + some]
                keys = variants(f).ravel()
                f, k = np.repeat(f, 64), np.repeat(k, 64)
                mixed = keys * np.uint64(0x9E3779B97F4A7C15)
                to = ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                ids, first = np.unique(to[order], return_index=True)
                cut = [*first.tolist(), len(order)]
                rows = [np.stack([keys[o], f[o], k[o]]).tobytes() for o in (order[s:e] for s, e in zip(cut, cut[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], names=["to", "rows"])
        trim()

    def meet(batches):
        trim()
        held = [np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for b in batches for x in b.column(1)]
        if held:
            all_ = np.concatenate(held, 1)
            held.clear()
            a, b = linked(all_[0], all_[1], all_[2].view(np.int64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            del all_, a, b
        trim()

    return nodes.select("fp", "node").mapInArrow(emit, "to int, rows binary").repartitionById(groups, F.col("to")).mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for docs(doc_id, text); component_id is the smallest doc_id reachable by links."""
    prints = stored(fingerprints(docs, words))
    nodes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    joined = components(links(nodes, nodes.count(), bits), forests=True)
    named = stored(nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
