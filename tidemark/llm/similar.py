"""All texts of a given Jaccard similarity on word shingles, and one of each group of them.

Deletion variants of SimHash fingerprints (simhash.links) propose first. What they cannot reach is found by an exact
way: two sets of that similarity share one of their rarest shingles (prefix filter), so texts that share one meet by
equality of it. Keys that few texts have propose all their pairs; of those with many, all texts first meet the one that
shares most of its prefix with others (a group's original, if it is there), and then those meet that links have not
joined. A proposal passes when a bound from parity bitmaps allows it and the whole sets confirm it. No pair is left out
by count. A sample of texts tells which shingles are common; that sets the order of shingles only, not the result.

Nulls count as empty texts, and texts without words are alike. A text of fewer words than a shingle is one shingle.
Rows without doc_id take no part; rows that repeat a doc_id are one document, like another if one of its texts is; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import components, parts, release, scratch, slices, stored
from tidemark.llm.simhash import links

#: Texts of the sample that tells common shingles, how often a common one is in it, and from when on it is a hot one.
SAMPLE, COMMON, HOT = 20_000, 3, 200
#: Entries of a group of keys; texts from which on a key first proposes one partner; bytes of text taken at once.
ENTRIES, MANY, CHUNK = 1_000_000, 16, 3_000_000
#: Candidate pairs that a task hands on at once.
BLOCK = 500_000

ENTRY = np.dtype([("key", "<u4"), ("doc", "<i8"), ("size", "<u4"), ("place", "<u2")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, in order by text and hash, and how many each text has."""
    tokens = [(t or "").encode().lower().split() for t in texts]
    many = np.fromiter(map(len, tokens), np.int64, len(tokens))
    word = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(tokens)), np.uint64, many.sum())
    n = np.where(many > 0, np.maximum(1, many - words + 1), 0)
    own = np.repeat(np.arange(len(tokens)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(many) - many, n)
    width = np.repeat(np.minimum(many, words), n)
    h = np.zeros(len(own), np.uint64)
    for j in range(words):
        on = width > j
        if on.all():
            h = mixed(h ^ word[at + j])
        else:
            h[on] = mixed(h[on] ^ word[at[on] + j])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[fresh], np.bincount(own[fresh], minlength=len(tokens))


def chunks(batches):
    """(ids, texts) of some rows at a time."""
    for b in slices(batches, CHUNK):
        yield b.column(0).to_numpy(), b.column(1).to_pylist()


def bitmaps(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of a set's hashes by their lowest bits, in words of 64 bits, and how many words each set has.

    A set of n has two to four bits for each element, a power of two in all; halves fold onto each other.
    """
    width = 1 << np.ceil(np.log2(np.maximum(64, 2 * n))).astype(np.int64)
    first = np.cumsum(width) - width
    own = np.repeat(np.arange(len(n)), n)
    bit = first[own] + (h & (width[own] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), width // 64


def prints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of sets: the bits that over half of the hashes have."""
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        for b in range(64):
            ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), first)
            out[some] |= (2 * ones > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(b)
    return out


def described(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp, bits) of rows(doc_id, text)."""

    def run(batches):
        for ids, texts in chunks(batches):
            h, n = sets(texts, words)
            bits, wide = bitmaps(h, n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(wide)], pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(prints(h, n).view(np.int64)), lists], names=["doc_id", "n", "fp", "bits"])

    return rows.mapInArrow(run, "doc_id long, n int, fp long, bits array<long>")


def prefix_size(n, similarity: float):
    """Of a set's rarest elements, so many that two sets of that similarity share one."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def common(rows: DataFrame, every: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are often in a sample of one in every so many documents, in order, and how often."""

    def run(batches):
        for _, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sets(texts, words)[0].view(np.int64))], names=["s"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(run, "s long")
    some = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toPandas()
    hashes = some.s.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], some.n.to_numpy(np.int64)[order]


def shared_entries(rows: DataFrame, entries: int, every: int, words: int, similarity: float) -> DataFrame:
    """(key, doc_id, size, place, many): the places of prefixes whose shingle many texts have in theirs, two at least.

    Keys stand for shingles; two shingles with one key only propose more. A hot shingle is dealt over several groups.
    """
    known = rows.sparkSession.sparkContext.broadcast(common(rows, every, words))
    groups = parts(entries, ENTRIES)

    def emit(batches):
        hashes, often = known.value
        for ids, texts in chunks(batches):
            h, n = sets(texts, words)
            own = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(h), np.int64)
            if len(hashes) and len(h):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                count = np.where(hashes[at] == h, often[at], 0)
            order = np.lexsort((h, count, own))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            in_ = place < np.repeat(prefix_size(n, similarity), n)
            h, own, place, count = h[order][in_], own[in_], place[in_], count[order][in_]
            none = np.flatnonzero(n == 0)  # sets without elements share a key of their own
            h, own, place, count = np.r_[h, np.zeros(len(none), np.uint64)], np.r_[own, none], np.r_[place, 0 * none], np.r_[count, 0 * none]
            e = np.zeros(len(h), ENTRY)
            e["key"], e["doc"], e["size"], e["place"] = h & np.uint64(0xFFFFFFFF), ids[own], n[own], np.minimum(place, 65535)
            hot = count >= HOT
            home = (h >> np.uint64(32)) % np.uint64(groups)
            to = np.where(hot, mixed(ids[own].astype(np.int64).view(np.uint64)) % np.uint64(groups), home).astype(np.int32)
            order = np.lexsort((hot, to))
            e, to, hot, home = e[order], to[order], hot[order], home[order]
            cut = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (hot[1:] != hot[:-1])]) if len(e) else []
            ends = [*cut[1:], len(e)]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut] if len(e) else [], pa.int32()), pa.array(hot[cut] if len(e) else [], pa.bool_()), pa.array([e[s:t].tobytes() for s, t in zip(cut, ends, strict=True)], pa.binary()), pa.array([home[s:t].astype("<u4").tobytes() if hot[s] else b"" for s, t in zip(cut, ends, strict=True)], pa.binary())], names=["to", "hot", "rows", "home"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for hot, of in part.groupby("hot"):
            e = np.frombuffer(b"".join(of.rows), ENTRY)
            key = e["key"].astype(np.int64)
            if hot:
                key |= np.frombuffer(b"".join(of.home), "<u4").astype(np.int64) << 32
                many, on = np.full(len(e), HOT, np.int64), np.ones(len(e), bool)
            else:
                _, back, size = np.unique(e["key"], return_inverse=True, return_counts=True)
                many, key = size[back], key | np.int64(part.to.iloc[0]) << 32
                on = many > 1
            found.append(pd.DataFrame({"key": key[on], "doc_id": e["doc"][on], "size": e["size"][on].astype(np.int32), "place": e["place"][on].astype(np.int32), "many": many[on].astype(np.int32)}))
        return pd.concat(found)

    blobs = rows.mapInArrow(emit, "to int, hot boolean, rows binary, home binary")
    return blobs.repartitionById(groups, F.col("to")).groupBy("to").applyInPandas(meet, "key long, doc_id long, size int, place int, many int")


def crossing(entries, similarity: float):
    """Blocks of pairs of one key and different labels that can be similar, in a frame in order of key.

    A pair that has the same key before this one in both texts has met there.
    """
    key, doc, size, place, label, before = (entries[c].to_numpy() for c in ("key", "doc_id", "size", "place", "label", "before"))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[first, len(key)])
    end = np.repeat(first + many, many)
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]):
        for s in range(0, len(at), BLOCK):
            i = at[s : s + BLOCK]
            j = i + step
            on = (label[i] != label[j]) & ((before[i] != before[j]) | (before[i] == -1))
            i, j = i[on], j[on]
            most = np.minimum(size[i] - place[i], size[j] - place[j])  # both sets end there
            on = most >= similarity * (size[i] + size[j] - most) - 1e-9
            i, j = doc[i[on]], doc[j[on]]
            if len(i):
                yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)}).drop_duplicates()
        step += 1


def met(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of entries(key, doc_id, size, place, before, label) of one key and different labels that can be similar."""

    def run(batches):
        all_ = [b for b in batches if len(b)]
        if all_:
            yield from crossing(pd.concat(all_).sort_values(["key", "doc_id"], ignore_index=True), similarity)

    return entries.repartition(parts(entries.count(), ENTRIES), "key").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, info: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar: bitmaps rule out most others before sets are compared."""

    def folded(x: Column, to: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > to, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    enough = lambda both, na, nb: both >= similarity * (na + nb - both) - 1e-9
    a, b = info.select("doc_id", "n", "bits").toDF("a", "na", "wa"), info.select("doc_id", "n", "bits").toDF("b", "nb", "wb")
    least = F.least(F.size("wa"), F.size("wb"))
    apart = F.aggregate(F.zip_with(folded(F.col("wa"), least), folded(F.col("wb"), least), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    left = pairs.where("a <> b").distinct().join(a, "a").join(b, "b").where(near).where(enough((F.col("na") + F.col("nb") - apart) / 2, F.col("na"), F.col("nb")))
    left = stored(left.select("a", "b").distinct())

    def run(batches):
        for ids, texts in chunks(batches):
            h, n = sets(texts, words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(h.view(np.int64)))], names=["doc_id", "s"])

    asked = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    whole = stored(rows.join(asked, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s array<long>"))
    both = F.size(F.array_intersect("sa", "sb"))
    return stored(left.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b").where(enough(both, F.size("sa"), F.size("sb"))).select("a", "b").distinct())


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the texts that a chain of verified links joins to another one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        info = stored(described(rows, words))
        size = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
        n_docs, n_entries = info.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()

        # fingerprints that differ in three bits at most, by deletion variants
        nodes = stored(info.groupBy("fp").agg(F.min("doc_id").alias("node")))
        same = info.join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        proposed = same.union(stored(links(nodes, nodes.count())))

        # texts that share a shingle of their prefixes
        entries = stored(shared_entries(rows, n_entries, max(1, n_docs // SAMPLE), words, similarity))
        w = Window.partitionBy("doc_id", "size")
        within = entries.withColumn("before", F.coalesce(F.lag("key").over(w.orderBy("place", "key")), F.lit(-1).cast("long")))
        entries = stored(within.withColumn("score", F.count("*").over(w) / (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)))
        large = entries.where(F.col("many") >= MANY)
        centre = large.groupBy("key").agg(F.max(F.struct("score", F.xxhash64("doc_id").alias("h"), "doc_id", "size")).alias("c"))
        star = large.join(centre, "key").where((F.col("doc_id") != F.col("c.doc_id")) & (F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - 1e-9))
        star = star.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b"))
        few = met(entries.where(F.col("many") < MANY).withColumn("label", F.col("doc_id")), similarity)
        found = confirmed(proposed.union(star).union(few), info, rows, words, similarity)
        release(docs.sparkSession)

        # texts of the large keys that no link has joined yet
        named = components(found).toDF("doc_id", "label")
        large = large.join(named, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        mixed_ = large.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
        large = stored(large.join(mixed_, "key", "left_semi"))
        found = found.union(confirmed(met(large, similarity), info, rows, words, similarity))
        return keep(components(found).toDF("doc_id", "component_id"))


def remove_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document, the smallest doc_id, of each group of similar() texts; all columns stay."""
    gone = similar(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
