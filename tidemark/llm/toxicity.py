"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens of toxic documents are labelled where one of their features (the word, its beginnings, its end) is far more
frequent in toxic than in clean training documents. A two-state chain is fitted to those labels by maximum
likelihood. Forward-backward marginals of every token of a text give its score, through a logistic curve fitted on
the training documents, and its offending offsets.
Nulls count as empty texts; an empty text has no tokens and the score of a text without findings; repeated rows are
scored one by one; an empty table gives an empty result; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, trim

#: Labelled documents of each kind that the model is fitted on, at most.
SAMPLE = 1500
BITS, CHAIN, CACHE, WIDTH = 20, 64, 150_000, 10
#: Bytes of text that are scored at once.
TOGETHER = 1_000_000
#: Texts that training works on at once.
SECTION = 1000
TOKEN = re.compile(r"\w+|[.!?\n]+")


def features(word: str) -> list[int]:
    """Hashed features of a word; as many for every word, 0 stands for none."""
    n = len(word)
    names = ["=" + word, "$" + word[-3:]]
    names += [f"{word[:k]}*" if n > k else "" for k in (4, 5, 6, 7)]
    names += [f"{word[:k]}*{min(n - k, 6)}" if n > k else "" for k in (4, 5, 6, 7)]
    return [zlib.crc32(x.encode()) % ((1 << BITS) - 1) + 1 if x else 0 for x in names]


@dataclass
class Model:
    """own: weights of a word's features; near: of the word before and the word after, by the word alone."""

    own: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    near: np.ndarray = field(default_factory=lambda: np.zeros((2, 1 << BITS), np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    curve: np.ndarray | None = None


class Words:
    """Numbers words; 0 is the end of a sentence. Holds the features of each word."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.held = array("I", [0] * WIDTH)
        self.n = 1

    def number(self, tokens: list[str]) -> np.ndarray:
        of, out = self.of, array("I")
        for w in tokens:
            i = of.get(w)
            if i is None:
                i = 0 if w[0] in ".!?\n" else self.n
                of[w] = i
                if i:
                    self.held.extend(features(w))
                    self.n += 1
            out.append(i)
        return np.frombuffer(out, np.uint32)

    def rows(self, first: int = 0) -> np.ndarray:
        """The features of the words from number first on."""
        return np.array(self.held[first * WIDTH :], np.int64).reshape(-1, WIDTH)


@dataclass
class Chains:
    """The words of some texts in a row, and their chains: where each starts, by length."""

    words: np.ndarray
    doc: np.ndarray
    token: np.ndarray
    by_length: dict[int, np.ndarray]
    first: np.ndarray
    last: np.ndarray


def chains(numbered: list[np.ndarray]) -> Chains:
    sizes = np.fromiter(map(len, numbered), np.int64, len(numbered))
    flat = np.concatenate([np.zeros(0, np.int64), *numbered]).astype(np.int64)
    doc = np.repeat(np.arange(len(numbered)), sizes)
    token = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stop = flat == 0
    key = np.cumsum(stop) + doc  # grows at each stop and at each new text
    words, doc, token, key = flat[~stop], doc[~stop], token[~stop], key[~stop]
    n = len(words)
    if not n:
        return Chains(words, doc, token, {}, stop[:0], stop[:0])
    new = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(new)
    at = np.arange(n) - np.repeat(begin, np.diff([*begin, n]))
    first = at % CHAIN == 0
    starts = np.flatnonzero(first)
    lengths = np.diff([*starts, n])
    last = np.concatenate([first[1:], [True]])
    return Chains(words, doc, token, {int(k): starts[lengths == k] for k in np.unique(lengths)}, first, last)


def unary(c: Chains, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    u = own[c.words].astype(float)
    if len(u) > 1:
        u[1:] += np.where(c.first[1:], 0, before[c.words[:-1]])
        u[:-1] += np.where(c.last[:-1], 0, after[c.words[1:]])
    return u


def marginals(c: Chains, u: np.ndarray, moves: np.ndarray, start: float, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The marginal of state 1 for every token by forward-backward; with pairs, the expected moves as well."""
    p, total = np.empty(len(u)), np.zeros((2, 2))
    e = np.exp(moves)
    for length, starts in c.by_length.items():
        at = starts[:, None] + np.arange(length)
        x = np.clip(u[at], -30, 30)
        a, b = np.empty_like(x), np.zeros_like(x)
        a[:, 0] = start + x[:, 0]
        for t in range(1, length):
            r = np.exp(a[:, t - 1])
            a[:, t] = x[:, t] + np.log((r * e[1, 1] + e[0, 1]) / (r * e[1, 0] + e[0, 0]))
        for t in range(length - 2, -1, -1):
            r = np.exp(x[:, t + 1] + b[:, t + 1])
            b[:, t] = np.log((e[1, 1] * r + e[1, 0]) / (e[0, 1] * r + e[0, 0]))
        p[at] = 1 / (1 + np.exp(-(a + b)))
        if pairs and length > 1:
            i, j = np.exp(a[:, :-1]), np.exp(x[:, 1:] + b[:, 1:])
            m = np.stack([np.full_like(i, e[0, 0]), e[0, 1] * j, e[1, 0] * i, e[1, 1] * i * j])
            total += (m / m.sum(0)).sum((1, 2)).reshape(2, 2)
    return p, total


def sums(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """What the curve sees of each text: the largest marginal, the log of their sum, and 1."""
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    return np.stack([top, np.log1p(np.bincount(doc, p, n)), np.ones(n)], 1)


def lowered(text: str | None) -> str:
    """A text in lower case with as many characters, so that places in it are places in the text."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60) -> Model:
    """The model of labelled whole texts."""
    model = Model()
    if not len(texts) or toxic.all() or not toxic.any():
        return model
    words, n, y = Words(), len(texts), toxic.astype(bool)
    numbered = [words.number(TOKEN.findall(lowered(t))) for t in texts]
    rows = words.rows()
    words.of.clear()
    sections = [(a, chains(numbered[a : a + SECTION])) for a in range(0, n, SECTION)]
    counts = np.zeros((2, 1 << BITS), np.int64)
    for a, c in sections:
        each = np.unique(c.doc * len(rows) + c.words)
        for part in np.split(each, np.searchsorted(each, np.arange(50, SECTION, 50) * len(rows))):  # fifty texts
            seen = np.unique(((part // len(rows))[:, None] << BITS | rows[part % len(rows)]).ravel())
            kind = y[a + (seen >> BITS)]
            counts += np.stack([np.bincount((seen & ((1 << BITS) - 1))[k], minlength=1 << BITS) for k in (~kind, kind)])
    good, bad = counts
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 1.5) / ((~y).sum() + 3))
    strong = (odds > np.log(8)) & (bad >= 5)
    strong[0] = False
    mark = strong[np.delete(rows, 1, axis=1)].any(1)
    tags = [(mark[c.words] & y[a + c.doc]).astype(float) for a, c in sections]
    # maximum likelihood by Adam; gradients gather on distinct words first, some texts at a time
    del counts, good, bad, odds
    used, rows_at = np.unique(np.append(rows, 0), return_inverse=True)  # only features that occur have weights
    at, m = rows_at[:-1].reshape(rows.shape), len(used)
    key = at[:, 0]
    state: list[list] = [[np.zeros(m), 0, 0], [np.zeros((2, m)), 0, 0], [np.zeros(5), 0, 0]]
    seen_moves = np.zeros((2, 2))
    for (_, c), tag in zip(sections, tags, strict=True):
        inner, y1, y0 = ~c.first[1:], tag[1:], tag[:-1]
        seen_moves += np.array([[((1 - y0) * (1 - y1))[inner].sum(), ((1 - y0) * y1)[inner].sum()], [(y0 * (1 - y1))[inner].sum(), (y0 * y1)[inner].sum()]])
    for k in range(1, rounds + 1):
        near, rest = state[1][0], state[2][0]
        own, left, right = state[0][0][at].sum(1), near[0][key], near[1][key]
        by_word, prev, nxt, moved, first = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows)), np.zeros((2, 2)), 0.0
        for (_, c), tag in zip(sections, tags, strict=True):
            p, pairs = marginals(c, unary(c, own, left, right), rest[:4].reshape(2, 2), rest[4], pairs=True)
            d, before_ok, after_ok = p - tag, ~c.first[1:], ~c.last[:-1]
            by_word += np.bincount(c.words, d, len(rows))
            prev += np.bincount(c.words[:-1][before_ok], d[1:][before_ok], len(rows))
            nxt += np.bincount(c.words[1:][after_ok], d[:-1][after_ok], len(rows))
            moved, first = moved + pairs, first + d[c.first].sum()
        grads = [np.bincount(at.ravel(), np.repeat(by_word, at.shape[1]), m), np.stack([np.bincount(key, prev, m), np.bincount(key, nxt, m)]), np.concatenate([(moved - seen_moves).ravel(), [first]])]
        for s, g in zip(state, grads, strict=True):
            g = g + 0.5 * s[0]
            s[1], s[2] = 0.9 * s[1] + 0.1 * g, 0.99 * s[2] + 0.01 * g * g
            s[0] = s[0] - 0.15 * (s[1] / (1 - 0.9**k)) / (np.sqrt(s[2] / (1 - 0.99**k)) + 1e-8)
        state[0][0][0] = 0
    model.own[used], model.near[:, used] = state[0][0], state[1][0]
    model.moves, model.start = state[2][0][:4].reshape(2, 2), float(state[2][0][4])
    own, left, right = state[0][0][at].sum(1), state[1][0][0][key], state[1][0][1][key]
    x = np.concatenate([sums(marginals(c, unary(c, own, left, right), model.moves, model.start)[0], c.doc, min(SECTION, n - a)) for a, c in sections])
    w = np.zeros(3)
    for _ in range(30):  # Newton's steps
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (q - y) + 0.1 * w)
    model.curve = w
    return model


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows whose crc32(doc_id as text) mod 5 is not 0; of each kind, sample rows at most."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    chosen = [label.where(F.col("toxic") == k).groupBy("doc_id", "toxic").count().orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic").limit(sample) for k in (0, 1)]
    ids = chosen[0].union(chosen[1])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text where rows repeat a doc_id
    rows = sorted((r.doc_id, r.toxic, r.text or "") for r in found.toLocalIterator())
    toxic = np.array([r[1] for r in rows], int)
    model = fit([r[2] for r in rows], toxic)
    trim()
    if model.curve is not None:  # the sample is more even than the labels are
        n = {r[0]: r[1] for r in label.groupBy("toxic").count().collect()}
        model.curve[2] += np.log(n[1] / n[0]) - np.log(toxic.sum() / (len(toxic) - toxic.sum()))
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): offsets of runs of tokens whose marginal is at least so much, in characters."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", spans)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 12 MB, whatever the input

    def run(batches):
        m, words = shared.value, Words()
        table = np.zeros((1, 3))
        for part in slices(batches, TOGETHER):
            if words.n > CACHE:
                words, table = Words(), np.zeros((1, 3))
            texts = [lowered(x.as_py()) for x in part.column(1)]
            c = chains([words.number(TOKEN.findall(t)) for t in texts])
            if words.n > len(table):
                f = words.rows(len(table))
                table = np.concatenate([table, np.stack([m.own[f].sum(1), m.near[0][f[:, 0]], m.near[1][f[:, 0]]], 1)])
            p, _ = marginals(c, unary(c, *table.T), m.moves, m.start)
            out = 1 / (1 + np.exp(-sums(p, c.doc, len(texts)) @ m.curve)) if m.curve is not None else np.zeros(len(texts))
            found: list[list[dict]] = [[] for _ in texts]
            hit = np.flatnonzero(p >= least) if m.curve is not None else []
            places: dict[int, list] = {}
            for i in hit:
                d, t = int(c.doc[i]), int(c.token[i])
                if d not in places:
                    places = {d: [x.span() for x in TOKEN.finditer(texts[d])]}
                s, e = places[d][t]
                if found[d] and i and p[i - 1] >= least and c.doc[i - 1] == d and not c.first[i]:
                    found[d][-1]["end"] = e
                else:
                    found[d].append({"start": s, "end": e})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out), pa.array(found, spans)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
