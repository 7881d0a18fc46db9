"""Hard negatives from an inverted multi-index.

A vector's two halves have a codebook each; a row lies in the cell of its two
nearest codewords. What a half can add to an inner product is bounded by its
codeword's product and radius, so a cell's scores lie between the sums of its
halves' bounds. An anchor walks the cells with a multi-sequence heap, highest
bound first, and stops where no cell can reach its window any more: that window
begins at a score which rows of the bounded sample, being rows themselves, are
known to reach. Visited cells are scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply.llm.common import by_batch, saved
from duoply.llm.topk import usable

#: Scores of a half or of a row that stay below this are exact in doubles.
EXACT = 1 << 53


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products (queries, rows), exact at any size."""
    most = x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    found = q.astype(object) @ x.astype(object).T
    if most >= 1 << 63 and len(found) and any(abs(v) >= 1 << 63 for v in found.ravel().tolist()):
        raise ValueError("a score doesn't fit a long")
    return found.astype(np.int64)


def codewords(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Codewords of some rows: Lloyd's rounds from distinct rows, spread over their order; as many as there are distinct rows at most."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(np.int64)] if len(distinct) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = nearest(x, centres)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword of each row."""
    return np.argmax(np.einsum("ij,kj->ik", x, centres) - (centres * centres).sum(axis=1) / 2, axis=1) if len(x) else np.zeros(0, dtype=np.int64)


class Index:
    """Codebooks of both halves, and a sample of rows that anchors begin with."""

    def __init__(self, dim: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: int):
        self.half = dim // 2
        self.ids, self.labels, self.v = ids, labels, v
        self.books = [codewords(part, codes) for part in self.halves(v)]
        self.radius = [np.full(len(b), -1.0) for b in self.books]
        self.cells: dict[tuple[int, int], int] = {}

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.half].astype(np.float64), v[:, self.half :].astype(np.float64)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes (rows, 2), distance of each half from its codeword)."""
        codes = np.stack([nearest(x, b) for x, b in zip(self.halves(v), self.books)], axis=1)
        far = np.stack([np.sqrt(((x - b[c]) ** 2).sum(axis=1)) for x, b, c in zip(self.halves(v), self.books, codes.T)], axis=1)
        return codes, far

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lowest, highest) product of each codeword's rows with the anchor, for both halves, with a margin above rounding."""
        out = []
        for a, book, radius in zip(self.halves(anchor[None, :]), self.books, self.radius):
            middle, reach = book @ a[0], np.sqrt((a[0] ** 2).sum()) * np.maximum(radius, 0)
            slack = 1e-9 * (np.abs(book) @ np.abs(a[0]) + reach) + 1e-3
            out.append((middle - reach - slack, middle + reach + slack))
        return out

    def visit(self, anchor: np.ndarray, floor: float, ceiling: float = float("inf")) -> Iterator[tuple[int, int]]:
        """Filled cells that may hold a score from floor to ceiling, in the order of their upper bounds; ends at the first bound below floor."""
        (low_a, high_a), (low_b, high_b) = self.bounds(anchor)
        a, b = np.argsort(-high_a, kind="stable"), np.argsort(-high_b, kind="stable")
        heap, seen = [(-(high_a[a[0]] + high_b[b[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor:
                return
            for m, n in ((i + 1, j), (i, j + 1)):
                if m < len(a) and n < len(b) and (m, n) not in seen:
                    seen.add((m, n))
                    heapq.heappush(heap, (-(high_a[a[m]] + high_b[b[n]]), m, n))
            cell = (int(a[i]), int(b[j]))
            if cell in self.cells and low_a[cell[0]] + low_b[cell[1]] <= ceiling:
                yield cell


def best_first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest score, ties by smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score with low * positive <= 100 * score <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def prepared(vectors: DataFrame, scale: float, label: Column) -> DataFrame:
    """(vec_id, label, v, dim): rows that take part, with integer components; of rows with one vec_id the smallest (vector, label) counts."""
    whole = lambda v: F.when(F.abs(v * F.lit(scale)) < F.lit(2.0**62), F.floor(v * F.lit(scale)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component reaches 2**62")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("embedding").cast("array<double>").alias("x"), label.cast("long").alias("label"))).alias("row"))
    return one.select("vec_id", F.col("row.label").alias("label"), F.transform("row.x", whole).alias("v")).withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=np.int64)


def build(rows: DataFrame, sample: int, cell_rows: int, most_codes: int) -> tuple[dict[int, Index], DataFrame]:
    """(index of each vector length, rows with their codes c0 and c1).

    Codebooks come from about `sample` rows (a hash of vec_id), which also bound
    what the driver holds; radii and cell sizes come from all rows. A length has
    a code for each root of its rows over `cell_rows`, `most_codes` at most.
    """
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    share = min(1 << 20, int(sample / max(1, sum(sizes.values())) * (1 << 20)))
    t = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < share).orderBy("vec_id").limit(4 * sample).toArrow()
    dims = t["dim"].to_numpy()
    index: dict[int, Index] = {}
    for dim, n in sizes.items():
        some = t.take(pa.array(np.flatnonzero(dims == dim)))
        v = matrix(some["v"]) if some.num_rows else np.zeros((0, dim), dtype=np.int64)
        index[dim] = Index(dim, some["vec_id"].to_numpy(), some["label"].to_numpy(), v, int(min(most_codes, max(2, round((n / cell_rows) ** 0.5)))))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def place(batch):
        out = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        dims, codes, far = batch.column(3).to_numpy(), np.zeros((batch.num_rows, 2), dtype=np.int32), np.zeros((batch.num_rows, 2))
        for dim in np.unique(dims).tolist():
            who = np.flatnonzero(dims == dim)
            codes[who], far[who] = shared.value[dim].place(matrix(batch.column(2).take(pa.array(who))))
        return out | {"c0": codes[:, 0], "c1": codes[:, 1], "far0": far[:, 0], "far1": far[:, 1]}

    placed = saved(by_batch(rows, place, "vec_id long, label long, v array<long>, dim int, c0 int, c1 int, far0 double, far1 double"))
    for r in placed.groupBy("dim", "c0", "c1").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect():
        own = index[r.dim]
        own.cells[(r.c0, r.c1)] = r.n
        for side, code, far in ((0, r.c0, r.far0), (1, r.c1, r.far1)):
            own.radius[side][code] = max(own.radius[side][code], far)
    return index, placed


def visits(anchors: DataFrame, index: dict[int, Index], need) -> DataFrame:
    """anchors with (c0, c1) of each cell that they visit. need(own index, anchor row) -> (floor, ceiling) of the scores that can matter, or None."""
    shared = anchors.sparkSession.sparkContext.broadcast(index)
    names = anchors.columns

    def run(batch):
        found = [[] for _ in range(batch.num_rows)]
        for k, row in enumerate(batch.to_pylist()):
            own, v = shared.value[row["dim"]], np.array(row["v"], dtype=np.int64)
            if (limits := need(own, v, row)) is not None:
                found[k] = [{"c0": a, "c1": b} for a, b in own.visit(v, *limits)]
        return {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {"cells": found}

    kinds = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
    walked = by_batch(anchors, run, f"{kinds}, cells array<struct<c0: int, c1: int>>")
    return walked.withColumn("cell", F.explode("cells")).select(*names, "cell.c0", "cell.c1")


def scored(placed: DataFrame, asking: DataFrame, blocks: DataFrame, fn, schema: str, queries: int) -> DataFrame:
    """fn(rows table, anchors table) on each block of a cell's rows and of the anchors that visit it; blocks(dim, c0, c1, parts) says into how many blocks the rows of a cell are split."""
    cell = ["dim", "c0", "c1"]
    asked = asking.groupBy(*cell).agg(F.ceil(F.count("*") / queries).cast("int").alias("turns"))
    plan = F.broadcast(blocks.join(asked, cell))  # a row a cell at most
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    empty = F.lit(None).cast("array<long>")
    left = placed.join(plan, cell).select(*cell, deal("parts").alias("row"), spread("turns").alias("col"), F.lit(False).alias("asks"), "vec_id", "label", "v", empty.alias("positive_ids"), empty.alias("positive_scores"))
    given = [F.col(c) if c in asking.columns else empty.alias(c) for c in ("positive_ids", "positive_scores")]
    right = asking.join(plan, cell).select(*cell, spread("parts").alias("row"), deal("turns").alias("col"), F.lit(True).alias("asks"), "vec_id", "label", "v", *given)

    def run(t: pa.Table) -> pa.Table:
        asks = np.array(t["asks"].to_pylist(), dtype=bool)
        return fn(t.take(pa.array(np.flatnonzero(~asks))), t.take(pa.array(np.flatnonzero(asks))))

    return left.union(right).groupBy(*cell, "row", "col").applyInArrow(run, schema)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, scale: float = 256.0, label: Column | None = None, sample: int = 4096, cell_rows: int = 2048, most_codes: int = 64, block: int = 8192, queries: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor (rows whose vec_id `every` divides).

    A score is the inner product of floor(scale * x) of both vectors. The
    anchor's positives are its `positives` best other rows of its label; for
    each, the first `negatives` rows of other labels whose score is between
    `low` and `high` percent of the positive's are returned, best first, ties to
    the smaller vec_id. A positive of negative score has an empty window.

    Rows with a null vec_id, label, vector or component, or a non-finite
    component, take no part, nor do empty vectors; vectors of different lengths
    don't meet; of repeated vec_ids the smallest (vector, label) counts. Results
    are exact whatever the sample. Cells of more than `block` rows (copies, say)
    are split by hash, as are anchors beyond `queries`; a block returns a few
    rows an anchor, and windows merge them.
    """
    rows = prepared(vectors, scale, F.col("label") if label is None else label)
    index, placed = build(saved(rows), sample, cell_rows, most_codes)
    session = vectors.sparkSession
    cells = [(dim, a, b, -(-n // block)) for dim, own in index.items() for (a, b), n in own.cells.items()]
    blocks = session.createDataFrame(cells, "dim int, c0 int, c1 int, parts int")
    anchors = placed.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v", "dim")

    def reach(own: Index, v: np.ndarray, row: dict):
        """The score that the sample already offers for the last positive."""
        mates = np.flatnonzero((own.labels == row["label"]) & (own.ids != row["vec_id"]))
        score = products(own.v[mates], v[None, :])[0]
        return (np.partition(score, len(score) - positives)[len(score) - positives] if len(score) >= positives else -np.inf,)

    def offer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"])
        out = []
        if len(ids) and asks.num_rows:
            who, kind = asks["vec_id"].to_numpy(), asks["label"].to_numpy()
            for k, score in enumerate(products(v, matrix(asks["v"]))):
                mates = np.flatnonzero((labels == kind[k]) & (ids != who[k]))
                top = mates[best_first(score[mates], ids[mates], positives)]
                out.append((np.full(len(top), who[k]), ids[top], score[top]))
        found = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), found)))

    first = scored(placed, saved(visits(anchors, index, reach)), blocks, offer, "anchor_id long, positive_id long, positive_score long", queries)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    kept = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    chosen = saved(chosen.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")))

    def span(own: Index, v: np.ndarray, row: dict):
        """From the least score that can still enter one of the windows to the greatest."""
        spans = [window(p, low, high) for p in row["positive_scores"] if p >= 0]
        if not spans:
            return None
        others = np.flatnonzero(own.labels != row["label"])
        score, floors = np.sort(products(own.v[others], v[None, :])[0]), []
        for least, most in spans:
            inside = score[np.searchsorted(score, least) : np.searchsorted(score, most, side="right")]
            floors.append(inside[-negatives] if len(inside) >= negatives else least)
        return min(floors), max(most for _, most in spans)

    def fill(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"])
        out = []
        if len(ids) and asks.num_rows:
            by_id = np.argsort(ids, kind="stable")
            ids, labels, v = ids[by_id], labels[by_id], v[by_id]
            kinds, given, scores = (asks[c].to_pylist() for c in ("label", "positive_ids", "positive_scores"))
            for k, (who, score) in enumerate(zip(asks["vec_id"].to_pylist(), products(v, matrix(asks["v"])))):
                spans = [window(p, low, high) for p in scores[k]]
                may = np.flatnonzero((labels != kinds[k]) & (score >= min(a for a, _ in spans)) & (score <= max(b for _, b in spans)))
                may = may[np.argsort(-score[may], kind="stable")]
                falling = -score[may]
                for positive, p, (least, most) in zip(given[k], scores[k], spans):
                    begin = np.searchsorted(falling, -most)
                    top = may[begin : min(begin + negatives, np.searchsorted(falling, -least, side="right"))]
                    out.append((np.full(len(top), who), np.full(len(top), positive), np.full(len(top), p), ids[top], score[top]))
        found = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), found)))

    asking = saved(visits(anchors.join(chosen, "vec_id"), index, span))
    found = scored(placed, asking, blocks, fill, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", queries)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
