"""Near-duplicate vectors by a navigable small-world graph for every shard.

Vectors compare within one label and dimension. Equal vectors collapse into one representative with a count first.
Representatives of a label are dealt to shards of bounded size; each shard gets a layered graph. Every shard is
queried with the representatives of every shard up to its own number, so that each pair has one place; a copy of its
graph meets the queries of several shards, one after another. A beam widens
for a query while all it holds are links, in the end to the whole shard, and for all queries of a task while an audit against brute force over the
shard finds less than the recall asked for. Links are verified by cosine in double precision and united.
Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing.
Repeated rows count one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, forest, stored

SHARD, LINKS, BUILD_BEAM, BATCH = 8192, 12, 48, 256
#: Shards of queries that meet one copy of a graph.
BLOCK = 8
#: The beam from which on a query that finds nothing but links has the whole shard as its beam.
WIDEST = 128


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, searched and built by batches."""

    def __init__(self, unit: np.ndarray, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.near = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry, self.top, done = 0, -1, 0
        while done < n:
            size = min(max(1, done // 2), BATCH, n - done)
            self._insert(np.arange(done, done + size))
            done += size

    def _insert(self, ids: np.ndarray) -> None:
        q = self.x[ids]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        here = np.full((len(ids), 1), self.entry)
        for k in range(min(max(self.top, int(self.level[ids].max())), len(self.near) - 1), -1, -1):
            part = np.flatnonzero(self.level[ids] >= k)
            if k <= self.top:
                found, sims = self.search(q, here, k, BUILD_BEAM if len(part) else 1)
                here = found[:, :8]
            else:
                found, sims = np.full((len(ids), 1), -1), np.full((len(ids), 1), -2.0, np.float32)
            if not len(part):
                continue
            mates = np.where((self.level[ids] >= k)[None, :], among, -2)[part]
            f = np.concatenate([found[part], np.where(mates > -2, ids[None, :], -1)], 1)
            s = np.concatenate([sims[part], mates], 1)
            f, s = self._best(f, s, BUILD_BEAM)
            width = self.near[k].shape[1]
            chosen = self._diverse(f, s, LINKS)
            self.near[k][ids[part], :LINKS] = chosen
            src, dst = np.repeat(ids[part], LINKS), chosen.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            if len(dst):
                self._back(k, dst, src, width)
        top = int(self.level[ids].max())
        if top > self.top:
            self.top, self.entry = top, int(ids[np.argmax(self.level[ids])])

    def _back(self, k: int, dst: np.ndarray, src: np.ndarray, width: int) -> None:
        order = np.argsort(dst, kind="stable")
        dst, src = dst[order], src[order]
        nodes, first, n = np.unique(dst, return_index=True, return_counts=True)
        add = np.full((len(nodes), int(n.max())), -1, np.int32)
        add[np.repeat(np.arange(len(nodes)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
        f = np.concatenate([self.near[k][nodes], add], 1)
        for at in range(0, len(nodes), BATCH):
            g = f[at : at + BATCH]
            s = np.where(g >= 0, np.einsum("bd,bmd->bm", self.x[nodes[at : at + BATCH]], self.x[g]), -2)
            g, s = self._best(g, s, max(width, min(g.shape[1], 3 * width)))
            full = (g >= 0).sum(1) > width
            out = g[:, :width].copy()
            if full.any():
                kept = self._diverse(g[full], s[full], width)
                out[full] = kept
            self.near[k][nodes[at : at + BATCH], : out.shape[1]] = out

    @staticmethod
    def _best(f: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n most similar of each row, most similar first; repeats become -1."""
        order = np.argsort(f, axis=1, kind="stable")
        f, s = np.take_along_axis(f, order, 1), np.take_along_axis(s, order, 1)
        same = np.concatenate([np.zeros((len(f), 1), bool), f[:, 1:] == f[:, :-1]], 1) | (f < 0)
        f, s = np.where(same, -1, f), np.where(same, -2, s)
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(f, order, 1), np.take_along_axis(s, order, 1)

    def _diverse(self, f: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """Of candidates in order, up to n that are nearer to the point than to one chosen already; then the rest in order."""
        v = self.x[f]
        pair = np.matmul(v, v.transpose(0, 2, 1))
        b, c = f.shape
        ok = np.zeros((b, c), bool)
        worst = np.full((b, c), -2.0, np.float32)
        for j in range(c):
            ok[:, j] = (f[:, j] >= 0) & (worst[:, j] < s[:, j])
            worst = np.where(ok[:, j : j + 1], np.maximum(worst, pair[:, j, :]), worst)
        order = np.argsort(np.where(f < 0, 2, np.where(ok, 0, 1)), axis=1, kind="stable")[:, :n]
        out = np.take_along_axis(f, order, 1)
        return np.pad(out, ((0, 0), (0, n - out.shape[1])), constant_values=-1).astype(np.int32)

    def search(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query in layer k, most similar first; -1 where empty."""
        b, n = len(q), len(self.x)
        rows = np.arange(b)
        seen = np.zeros((b, n + 1), bool)  # the last column stands for none
        seen[:, n] = True
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2.0, np.float32)
        open_ = np.zeros((b, beam), bool)
        fresh = np.where(entry < 0, n, entry)
        each = 1 if beam == 1 else max(4, beam // 12)
        while len(rows):
            fresh = np.sort(fresh, axis=1)
            skip = seen[rows[:, None], fresh]
            skip[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            seen[rows[:, None], fresh] = True
            s = np.where(skip, -2, np.einsum("bd,bmd->bm", q[rows], self.x[np.minimum(fresh, n - 1)]))
            f = np.where(skip, -1, fresh)
            alls = np.concatenate([sims[rows], s], 1)
            cut = np.argsort(-alls, axis=1, kind="stable")[:, :beam]
            sims[rows] = np.take_along_axis(alls, cut, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], f], 1), cut, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], ~skip], 1), cut, 1)
            rows = rows[open_[rows].any(1)]
            if not len(rows):
                break
            pick = np.argsort(~open_[rows], axis=1, kind="stable")[:, :each]
            live = np.take_along_axis(open_[rows], pick, 1)
            at = np.where(live, np.take_along_axis(ids[rows], pick, 1), -1)
            o = open_[rows]
            np.put_along_axis(o, pick, False, 1)
            open_[rows] = o
            fresh = np.where(at[:, :, None] >= 0, self.near[k][at], -1).reshape(len(rows), -1)
            fresh = np.where(fresh < 0, n, fresh)
        return ids, sims

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        here = np.full((len(q), 1), self.entry)
        for k in range(self.top, 0, -1):
            here = self.search(q, here, k, 4)[0]
        return self.search(q, here, 0, min(beam, len(self.x)))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pairs(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, same: bool, recall: float = 0.999, audit: int = 64, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all links found; with same, queries are the points and each pair comes once, smaller first."""
    n = len(x)
    q32 = q.astype(np.float32)
    some = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    true = q[some] @ x.T >= least
    while True:
        a, b = [], []
        for at in range(0, len(q), BATCH):
            todo, width = np.arange(at, min(at + BATCH, len(q))), beam
            while len(todo):
                if width > max(WIDEST, beam) or width >= n:  # as wide as the shard: every point is in it
                    i, j = np.nonzero(q[todo] @ x.T >= least)
                    a.append(todo[i])
                    b.append(j)
                    break
                ids, sims = graph.query(q32[todo], width)
                more = sims[:, -1] >= least - 1e-4  # nothing but links: there may be others
                i, j = np.nonzero((sims >= least - 1e-4) & (ids >= 0) & ~more[:, None])
                a.append(todo[i])
                b.append(ids[i, j])
                todo, width = todo[more], width * 2
        a_, b_ = np.concatenate(a), np.concatenate(b)
        exact = np.concatenate([np.einsum("ij,ij->i", q[a_[s : s + 100_000]], x[b_[s : s + 100_000]]) for s in range(0, len(a_), 100_000)] or [np.zeros(0)])
        a_, b_ = a_[exact >= least], b_[exact >= least]
        got = np.zeros(true.shape, bool)
        row = np.searchsorted(some, a_)
        row[row == len(some)] = 0
        m = some[row] == a_
        got[row[m], b_[m]] = True
        if (got & true).sum() >= recall * true.sum() or beam >= n:
            break
        beam *= 2
    if same:
        lo, hi = np.minimum(a_, b_), np.maximum(a_, b_)
        key = np.unique((lo * n + hi)[lo != hi])
        a_, b_ = key // n, key % n
    return a_, b_


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors(vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    bad = F.col("v").isNull() | F.col("label").isNull() | F.col("vec_id").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(True))).withColumn("dim", F.size("v"))
    reps = rows.where("not bad").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = stored(reps)
    sizes = stored(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        x = unit(np.stack(part.v.to_numpy()))
        data = pickle.dumps((Graph(x), x, part.rep.to_numpy(), part.n.to_numpy()), protocol=5)
        return pd.DataFrame({"label": part.label[:1], "dim": part.dim[:1], "shards": part.shards[:1], "shard": part["shard"][:1], "graph": [data]})

    kind = vectors.schema["label"].dataType.simpleString()
    graphs = stored(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shards int, shard int, graph binary"))
    asked = graphs.select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.floor(F.col("shard") / BLOCK).cast("int"))).alias("block"), "graph")
    queries = dealt.select("label", "dim", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("at"), F.floor(F.col("shard") / BLOCK).cast("int").alias("block"), F.col("shard").alias("own"), "rep", "n", "v").withColumnRenamed("at", "shard")

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": np.zeros(0, int), "a": np.zeros(0, int), "b": np.zeros(0, int)})]
        if not len(left) or not len(right):
            return out[0]
        graph, x, rep, n = pickle.loads(left.graph[0])
        others, trees = np.zeros(len(x), np.int64), []
        for own, some in right.groupby("own"):
            same = int(own) == int(left["shard"][0])
            if same:
                q, qrep, qn = x, rep, n
            else:
                some = some.sort_values("rep", ignore_index=True)
                q, qrep, qn = unit(np.stack(some.v.to_numpy())), some.rep.to_numpy(), some.n.to_numpy()
            a, b = pairs(graph, x, q, least, same)
            others += np.bincount(b, qn[a], len(x)).astype(np.int64)
            out.append(pd.DataFrame({"kind": 0, "a": qrep, "b": np.bincount(a, n[b], len(q)).astype(np.int64)}))
            trees.append(forest(qrep[a], rep[b]))
        fa, fb = forest(np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]))
        return pd.concat([*out, pd.DataFrame({"kind": 0, "a": rep, "b": others}), pd.DataFrame({"kind": 1, "a": fa, "b": fb})])

    by = ["label", "dim", "shard", "block"]
    found = stored(asked.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(ask, "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    joined = components(found.where("kind = 1").select("a", "b")).toDF("rep", "component")
    classes = reps.join(counts, "rep", "left").join(joined, "rep", "left")
    classes = stored(classes.select("label", "dim", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    good = rows.where("not bad").join(classes, ["label", "dim", "v"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    out = good.union(rows.where("bad").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
