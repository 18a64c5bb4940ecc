"""Removes passages that an earlier document has, by suffix arrays in shards.

A window of 50 bytes has an anchor: the leftmost of its 16-byte strings with the smallest hash. Equal windows have equal
anchors, so windows are dealt to shards by their anchors' hash and equal ones meet. Consecutive windows with one anchor
travel as one stretch of 50 to 84 bytes.

1. Batches of whole documents send each anchor's hash once; the ones found in two documents come back.
2. Batches send the stretches of those, each distinct one once, with the smallest document that has it. Larger
   documents of the same batch are covered there and then.
3. A shard covers the larger documents of equal stretches, and sorts the suffixes of all distinct stretches whose anchor
   occurs in another one too: its array is induced from leftmost-smaller suffixes, permuted common prefixes of 50 bytes
   bound the runs of equal windows, and the smallest document of a run covers the others.
4. Batches remove what is covered.

Copies of whole texts are set apart beforehand: they are covered from end to end.
A null text is empty; texts of less than 50 bytes stay; a row without doc_id stays and covers nothing; rows that repeat
a doc_id don't cover each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bucketed, parts, release, stored, trim, uncollected
from tidemark.llm.suffixes import shares_prefix, suffix_array

LENGTH, GRAM = 50, 16
#: Bytes of a batch, of the text behind one group of hashes and of stretches; batches in a bucket; windows at a time.
BATCH, HASHES, STRETCHES, TOGETHER, SLICE = 8_000_000, 16_000_000, 6_000_000, 3, 500_000


def grams(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of each string of k bytes (k is a power of two); its lowest bit is 0."""
    h, p, have = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while have < k:
        h = h[:-have] * np.uint64(p) + h[have:]
        p, have = p * p % (1 << 64), 2 * have
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h & np.uint64(0xFFFFFFFFFFFFFFFE)


def stretches(texts: list[bytes], length: int = LENGTH):
    """Yields (hash, text number, start, size) of stretches of windows with one anchor, some texts' at a time."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    width = length - GRAM + 1
    for begin in range(0, len(whole), SLICE):
        b = whole[begin : begin + SLICE + length - 1]
        if len(b) < length:
            break
        h = grams(b)
        low, at, have = h, np.arange(len(h), dtype=np.int32), 1
        while have < width:
            step = min(have, width - have)
            left = low[:-step] <= low[step:]
            low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
            have += step
        n = len(b) - length + 1
        w = np.arange(begin, begin + n)
        text = np.searchsorted(ends, w, side="right")
        ok = w + length <= ends[text]
        w, text, at, low = w[ok], text[ok], at[:n][ok], low[:n][ok]
        if not len(w):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        size = np.diff([*first, len(w)]) + length - 1
        yield low[first], text[first], w[first] - (ends - sizes)[text[first]], size


def removed(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in an interval."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def covered(stretch: list[bytes], own: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(stretch, first byte, last byte + 1) that windows of stretches with a smaller number own hold as well."""
    sizes = np.array([len(x) for x in stretch])
    raw = np.frombuffer(b"\0".join(stretch) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(stretch), dtype=np.int32), sizes + 1)
    at = (np.arange(len(raw)) - starts[of]).astype(np.int32)
    s = raw.astype(np.int32) + 2
    s[at == sizes[of]] = 1
    order = suffix_array(np.append(s, np.int32(0)))[1:]
    valid = at + length <= sizes[of]
    padded = np.concatenate([raw, np.zeros(length + 16, np.uint8)])
    order = order[valid[order]]
    same = shares_prefix(padded, order, length)
    runs = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(own[of[order]], runs), np.diff([*runs, len(order)]))
    hit = np.sort(order[least < own[of[order]]])
    if not len(hit):
        return []
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
    first, last = hit[new], hit[np.concatenate([new[1:], [True]])]
    return list(zip(of[first].tolist(), at[first].tolist(), (at[last] + length).tolist(), strict=True))


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for docs(doc_id, text)."""
    spark = docs.sparkSession
    t = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    slim = stored(rows.select("doc_id", "digest", F.octet_length("text").alias("n")).where(F.col("n") >= length).where("doc_id is not null"))
    copies = stored(slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"))
    total = slim.agg(F.sum("n")).first()[0] or 0
    batches, hash_groups, groups = parts(total, BATCH), parts(total, HASHES), parts(total, STRETCHES)
    batch = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)).alias("batch")
    gone = stored(slim.join(copies, "digest").where("doc_id > least").select("doc_id", "digest").distinct().select("doc_id", "digest", batch))
    release(spark)
    work = rows.where(F.octet_length("text") >= length).where("doc_id is not null")
    work = bucketed(work.select("doc_id", "digest", "text", batch), "batch", min(parts(batches, TOGETHER), 50_000))
    release(spark)

    def beside(found: DataFrame | None = None) -> DataFrame:
        """What a batch needs besides its texts: (batch, data) of found, and which of its rows are copies."""
        copied = gone.select("batch", F.lit(None).cast("binary").alias("data"), "doc_id", "digest")
        none = (F.lit(0).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"))
        return copied if found is None else copied.unionByName(found.select("batch", "data", *none))

    def apart(part: pd.DataFrame, side: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """A batch's rows that are no copies, in order: their places there name them in all steps; and the found data."""
        trim()
        part, copied = in_order(part), side[side.digest.notna()]
        if len(copied):
            known = set(zip(copied.doc_id.tolist(), map(bytes, copied.digest), strict=True))
            keep = [x not in known for x in zip(part.doc_id.tolist(), map(bytes, part.digest), strict=True)]
            part = part[keep].reset_index(drop=True)
        return part, side[side.data.notna()]

    def in_order(part: pd.DataFrame) -> pd.DataFrame:
        """A batch's rows by document and text."""
        return part.sort_values(["doc_id", "digest"], ignore_index=True)

    def deal(h: np.ndarray, groups: int):
        to = ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ids, first = np.unique(to[order], return_index=True)
        return zip(ids.tolist(), np.split(order, first[1:]), strict=True) if len(ids) else ()

    def ask(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        part, _ = apart(part, side)
        found, texts = [], part.text.tolist()
        for h, text, _, _ in stretches(texts, length):
            pairs = np.unique(np.stack([h, text.astype(np.uint64)]), axis=1) if len(h) < 2 else None
            if pairs is None:
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                m = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
                found.append((h[m], text[m]))
            else:
                found.append((pairs[0], pairs[1].astype(np.int64)))
        if not found:
            return pd.DataFrame({"to": [], "batch": [], "data": []}).astype({"to": int, "batch": int})
        h, text = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.lexsort((text, h))
        h, text = h[order], text[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        more = np.maximum.reduceat(text, begin) != np.minimum.reduceat(text, begin)
        h = h[begin] | more.astype(np.uint64)
        got = [(to, h[o].tobytes()) for to, o in deal(h, hash_groups)]
        return pd.DataFrame({"to": [x[0] for x in got], "batch": int(part.batch.iloc[0]), "data": [x[1] for x in got]})

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        trim()
        each = [np.frombuffer(x, np.uint64) for x in part.data]
        x = np.concatenate(each)
        h = x & np.uint64(0xFFFFFFFFFFFFFFFE)
        order = np.argsort(h, kind="stable")
        v = h[order]
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff([*begin, len(v)])
        many = np.empty(len(x), bool)
        many[order] = np.repeat((n > 1) | (np.maximum.reduceat(x[order] & np.uint64(1), begin) > 0), n)
        cut = np.cumsum([len(e) for e in each])[:-1]
        return pd.DataFrame({"batch": part.batch.to_numpy(), "data": [a[m].tobytes() for a, m in zip(np.split(h, cut), np.split(many, cut), strict=True)]})

    empty = pd.DataFrame({"to": np.zeros(0, int), "batch": np.zeros(0, int), "cover": np.zeros(0, bool), "data": []})

    def send(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        part, answers = apart(part, answers)
        if not len(part) or not len(answers):
            return empty
        known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in answers.data]))
        if not len(known):
            return empty
        texts, ids = part.text.tolist(), part.doc_id.tolist()
        first: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}
        local: list[tuple[int, int, int]] = []
        for h, text, start, size in stretches(texts, length):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            m = known[at] == h
            for x, i, s, n in zip(h[m].tolist(), text[m].tolist(), start[m].tolist(), size[m].tolist(), strict=True):
                piece, doc = texts[i][s : s + n], ids[i]
                seen = first.get(piece)
                if seen is None or doc < seen[1]:
                    if seen is not None:
                        local += [(r, a, a + n) for r, a in seen[2]]
                    first[piece] = (x, doc, [(i, s)])
                elif doc == seen[1]:
                    seen[2].append((i, s))
                else:
                    local.append((i, s, s + n))
        batch, out = int(part.batch.iloc[0]), []
        flat = [(x, doc, r, s, piece) for piece, (x, doc, where) in first.items() for r, s in where]
        h = np.array([x[0] for x in flat], np.uint64)
        for to, o in deal(h, groups):
            some = [flat[i] for i in o.tolist()]
            data = ([x[0] for x in some], [x[1] for x in some], [x[2] for x in some], [x[3] for x in some])
            kinds = (np.uint64, np.int64, np.int64, np.int64)
            out.append((to, False, pickle.dumps((*[np.array(d, k) for d, k in zip(data, kinds, strict=True)], np.array([len(x[4]) for x in some], np.uint8), b"".join([x[4] for x in some])), protocol=5)))
        if local:
            out.append((batch % groups, True, np.array(local, np.int64).tobytes()))
        return pd.DataFrame({"to": [x[0] for x in out], "batch": batch, "cover": [x[1] for x in out], "data": [x[2] for x in out]}) if out else empty

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        trim()
        out = [(b, d) for b, c, d in zip(part.batch.tolist(), part.cover.tolist(), part.data.tolist(), strict=True) if c]
        asked = part[~part.cover.astype(bool)]
        least: dict[bytes, int] = {}
        of_anchor: dict[int, int] = {}
        entries = []
        for b, data in zip(asked.batch.tolist(), asked.data.tolist(), strict=True):
            h, doc, row, start, size, raw = pickle.loads(data)
            at = 0
            for x, d, r, s, n in zip(h.tolist(), doc.tolist(), row.tolist(), start.tolist(), size.tolist(), strict=True):
                piece = raw[at : at + n]
                at += n
                old = least.get(piece)
                if old is None:
                    of_anchor[x] = of_anchor.get(x, 0) + 1
                    least[piece] = d
                elif d < old:
                    least[piece] = d
                entries.append((b, x, d, r, s, piece))
        number: dict[bytes, int] = {}
        for _, x, _, _, _, piece in entries:
            if of_anchor[x] > 1:
                number.setdefault(piece, len(number))
        inside: dict[int, list[tuple[int, int]]] = {}
        if number:
            names = list(number)
            for i, a, e in covered(names, np.array([least[p] for p in names], np.int64), length):
                inside.setdefault(i, []).append((a, e))
        covers: dict[int, list[tuple[int, int, int]]] = {}
        for b, _, d, r, s, piece in entries:
            if d > least[piece]:
                covers.setdefault(b, []).append((r, s, s + len(piece)))
            else:
                for a, e in inside.get(number.get(piece, -1), ()):
                    covers.setdefault(b, []).append((r, s + a, s + e))
        out += [(b, np.array(c, np.int64).tobytes()) for b, c in covers.items()]
        return pd.DataFrame({"batch": np.array([x[0] for x in out], np.int64), "data": [x[1] for x in out]})

    def cut(part: pd.DataFrame, covers: pd.DataFrame) -> pd.DataFrame:
        part, covers = apart(part, covers)
        if not len(part):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}).astype({k: int for k in ("doc_id", "n_bytes", "n_removed", "n_spans")})
        all_ = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in covers.data]) if len(covers) else np.zeros((0, 3), np.int64)
        all_ = all_[np.argsort(all_[:, 0], kind="stable")]
        out = []
        for row, (doc, text) in enumerate(zip(part.doc_id.tolist(), part.text.tolist(), strict=True)):
            a, e = np.searchsorted(all_[:, 0], row, "left"), np.searchsorted(all_[:, 0], row, "right")
            if a == e:
                out.append((doc, len(text), 0, 0, text))
                continue
            m = removed(len(text), all_[a:e, 1], all_[a:e, 2])
            out.append((doc, len(text), int(m.sum()), int(m[0]) + int((m[1:] & ~m[:-1]).sum()), np.frombuffer(text, np.uint8)[~m].tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    asked = work.groupBy("batch").cogroup(beside().groupBy("batch")).applyInPandas(lambda part, side: uncollected(ask, part, side), "to int, batch long, data binary").repartitionById(hash_groups, F.col("to"))
    answers = stored(asked.groupBy("to").applyInPandas(answer, "batch long, data binary"))
    release(spark)
    sent = work.groupBy("batch").cogroup(beside(answers).groupBy("batch")).applyInPandas(lambda part, side: uncollected(send, part, side), "to int, batch long, cover boolean, data binary").repartitionById(groups, F.col("to"))
    covers = stored(sent.groupBy("to").applyInPandas(lambda part: uncollected(sort, part), "batch long, data binary"))
    release(spark)
    out = work.groupBy("batch").cogroup(beside(covers).groupBy("batch")).applyInPandas(lambda part, side: uncollected(cut, part, side), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    n = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    short = rows.where((F.octet_length("text") < length) | F.col("doc_id").isNull()).select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    again = slim.join(gone, ["doc_id", "digest"], "left_semi").select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return out.union(short).union(again)
