"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into balanced parts;
a small network learns which parts the neighbours of a vector lie in. Every row
is stored under its most probable part, and a query visits its most probable
parts, as many as the sample's own neighbours need, where exact distances rerank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoply.llm.common import by_batch, saved
from duoply.llm.topk import one_each


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    square, out = (x * x).sum(axis=1), np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), 512):
        d = square[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1), axis=1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Part of each row: rows go where most of their neighbours are, and no part takes more than `slack` times its share."""
    rng, n = np.random.default_rng(7), len(x)
    room = int(slack * n / parts) + 1
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(5):
        part = np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
    pull = x @ centres.T - (centres * centres).sum(axis=1) / 2
    pull = 0.5 * (pull - pull.min()) / max(float(np.ptp(pull)), 1e-9)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1.0)
        votes += pull
        free, part = np.full(parts, room), part.copy()
        for i in np.argsort(-votes.max(axis=1), kind="stable"):  # the surest rows choose first
            part[i] = p = np.argmax(np.where(free > 0, votes[i], -np.inf))
            free[p] -= 1
    return part


class Router:
    """One hidden layer; predicts the shares of a vector's neighbours in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, rate: float = 3e-3):
        epochs = max(epochs, -(-400 * 256 // len(x)))  # 400 steps at least
        rng = np.random.default_rng(11)
        self.middle, self.spread = x.mean(axis=0), max(float(x.std()), 1e-12)
        self.w = [rng.normal(0, d**-0.5, (d, m)) for d, m in ((x.shape[1], hidden), (hidden, target.shape[1]))] + [np.zeros(hidden), np.zeros(target.shape[1])]
        x = (x - self.middle) / self.spread
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[rows] @ self.w[0] + self.w[2], 0)
                off = (self._share(h) - target[rows]) / len(rows)
                back = (off @ self.w[1].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ back, h.T @ off, back.sum(axis=0), off.sum(axis=0))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _share(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.w[1] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Shares of the parts, a row for each vector; summed in the same order whatever the batch."""
        h = np.maximum(np.einsum("ij,jk->ik", (x - self.middle) / self.spread, self.w[0]) + self.w[2], 0)
        return self._share(h)


#: A part needs so many rows of the sample; with fewer than twice as many there is nothing to divide, and all rows are one part.
FEWEST = 32


class Index:
    """What the sample teaches: the router, and how many parts a query visits."""

    def __init__(self, x: np.ndarray, parts: int, k: int, cover: float, graph: int = 10):
        self.parts, self.visits, self.router = 1, 1, None
        parts = min(parts, len(x) // FEWEST)
        if parts < 2:
            return
        near = neighbours(x, max(graph, k))
        part = balanced_parts(x, near[:, :graph], parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph), part[near[:, :graph]].ravel()), 0.8 / graph)
        target[np.arange(len(x)), part] += 0.2
        learn = np.arange(len(x)) % 8 != 0
        self.parts, self.router = parts, Router(x[learn], target[learn])
        share = self.router(x)
        home = share.argmax(axis=1)
        ask = np.flatnonzero(~learn)  # rows that the router has not seen, as queries
        place = np.argsort(np.argsort(-share[ask], axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, home[near[ask, :k]], axis=1).ravel())
        self.visits = min(parts, int(needed[min(len(needed) - 1, int(cover * len(needed)))]) + 1)

    def route(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable parts of each vector, most probable first."""
        return np.zeros((len(x), 1), dtype=np.int64) if self.router is None else np.argsort(-self.router(x), axis=1, kind="stable")[:, :visits]

    def visited(self, x: np.ndarray, stored: np.ndarray, k: int) -> list[list[int]]:
        """The parts that each query visits: the most probable ones, and more of them while those hold no k rows beside the query itself."""
        out = []
        for order in self.route(x, self.parts):
            enough = int(np.searchsorted(np.cumsum(stored[order]), k + 1)) + 1
            out.append(order[: max(self.visits, enough)].tolist())
        return out


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query_id, vec_id, distance) of each query's k nearest rows in one block. A product shortlists with a margin far above its rounding; distances are then taken from the differences."""
    square = (x * x).sum(axis=1)
    out = []
    for i in range(len(q)):
        d = square - 2 * (x @ q[i])
        d[ids == query_ids[i]] = np.inf
        n = min(k, int(np.isfinite(d).sum()))
        if not n:
            continue
        limit = np.partition(d, n - 1)[n - 1]
        rows = np.flatnonzero(d <= limit + 1e-9 * (1 + square.max() + (q[i] * q[i]).sum()))
        exact = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
        rows, exact = (a[np.lexsort((ids[rows], exact))[:k]] for a in (rows, exact))
        out.append((np.full(len(rows), query_ids[i]), ids[rows], exact))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]


def fit(rows: DataFrame, n: int, k: int, sample: int = 8192, part_rows: int = 1500, least_parts: int = 8, cover: float = 0.97) -> Index:
    """An index of rows (vec_id, vector) of one length, from about `sample` of them (hash of vec_id): the bound of what the driver holds.

    There is a part for each `part_rows` rows, `least_parts` at least, and one
    for FEWEST rows of the sample at most; so a larger collection wants a larger
    sample.
    """
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < min(1 << 20, int(sample / max(n, 1) * (1 << 20)))
    t = rows.where(share).orderBy("vec_id").select("vector").toArrow()
    x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
    return Index(x, max(least_parts, n // part_rows), k, cover)


def search(vectors: DataFrame, k: int = 10, every: int = 100, rows: int = 4096, queries: int = 1024, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id `every` divides.

    Parts are searched in cells of about `rows` by `queries`, dealt by hash, so
    a part of a third of all rows (copies) spreads over as many tasks as it
    needs. Null, zero, empty and non-finite vectors take no part, nor do
    vectors whose length isn't the most frequent one; of repeated vec_ids the
    smallest vector counts. A query whose parts hold fewer than k other rows
    visits further ones, so k rows are found wherever there are k.
    """
    usable = one_each(vectors).where(F.exists("vector", lambda v: v != 0)).withColumn("dim", F.size("vector"))
    clean = saved(usable)
    dims = clean.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.col("dim") == dims.dim)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(clean, dims["count"], k, **settings))
    index = shared.value

    def route(batch):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return {"vec_id": batch.column(0), "vector": batch.column(1), "part": shared.value.route(x, 1)[:, 0]}

    routed = saved(by_batch(clean.select(F.col("vec_id").cast("long").alias("vec_id"), "vector"), route, "vec_id long, vector array<double>, part int"))
    stored, asked, held = [1] * index.parts, [1] * index.parts, np.zeros(index.parts, dtype=np.int64)
    for r in routed.groupBy("part").count().collect():
        stored[r.part], held[r.part] = -(-r["count"] // rows), r["count"]

    def ask(batch):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return {"vec_id": batch.column(0), "vector": batch.column(1), "visits": shared.value.visited(x, held, k)}

    asking = saved(by_batch(routed.where(F.col("vec_id") % every == 0).select("vec_id", "vector"), ask, "vec_id long, vector array<double>, visits array<int>")).withColumn("part", F.explode("visits")).drop("visits")
    for r in asking.groupBy("part").count().collect():
        asked[r.part] = -(-r["count"] // queries)
    size = lambda of, part: F.element_at(F.array(*map(F.lit, of)), F.col(part) + 1)
    deal = lambda of, part: F.pmod(F.xxhash64("vec_id"), size(of, part)).cast("int")
    spread = lambda of, part: F.explode(F.sequence(F.lit(0), size(of, part) - 1))
    left = routed.select("part", deal(stored, "part").alias("row"), spread(asked, "part").alias("col"), F.lit(False).alias("asks"), "vec_id", "vector")
    right = asking.select("part", spread(stored, "part").alias("row"), deal(asked, "part").alias("col"), F.lit(True).alias("asks"), "vec_id", "vector")

    def cell(t: pa.Table) -> pa.Table:
        asks = np.array(t["asks"].to_pylist(), dtype=bool)
        ids = t["vec_id"].to_numpy()
        x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        found = nearest(ids[~asks], x[~asks], ids[asks], x[asks], k) if asks.any() and not asks.all() else nearest(ids[:0], x[:0], ids[:0], x[:0], k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    found = left.union(right).groupBy("part", "row", "col").applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
