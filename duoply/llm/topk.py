"""Exact top-k inner products on a bit-sliced index.

A block of rows is kept as bitmaps, one for each bit of each dimension. A
query's scores are sums of shifted slices, added with bitmap arithmetic for 64
rows at a time and many queries side by side. Each query then walks its sum from
the most significant slice downward, keeping rows that are surely among the k
best and rows that still may be; ties at the border go to the smallest vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, and every component finite."""
    x = vector.cast("array<double>")
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def one_each(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of usable rows; of rows with the same vec_id the smallest vector counts."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("vector"))


def slices(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps (dimensions, bits, words) of x - min(x), that minimum); row r is bit r % 64 of word r // 64."""
    low = int(x.min())
    x = (x - low).astype(np.uint64)
    bits = max(1, int(x.max()).bit_length())
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits((x >> np.uint64(b) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64), low


def sums(bitmaps: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Slices (queries, words) of sum_d |q_d| * y_d, where y_d is a row's value, or its complement if q_d is negative: the score but for a constant of each query."""
    d, bits, words = bitmaps.shape
    size = np.abs(q).astype(np.uint64)
    most = max(sum(row) for row in size.tolist()) * ((1 << bits) - 1)
    total = [np.zeros((len(q), words), dtype=np.uint64) for _ in range(max(1, most.bit_length()))]
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(d):
        turn = np.where(q[:, j] < 0, every, np.uint64(0))[:, None]
        for a in range(int(size[:, j].max()).bit_length()):
            if not len(who := np.flatnonzero(size[:, j] >> np.uint64(a) & np.uint64(1))):
                continue
            some = len(who) < len(q)
            mask = np.where(size[:, j] >> np.uint64(a) & np.uint64(1), every, np.uint64(0))[:, None]
            carry = None
            for p in range(a, len(total)):
                if p - a < bits:
                    add = bitmaps[j, p - a] ^ turn
                    if some:
                        add &= mask
                    both = total[p] & add
                    total[p] ^= add
                    if carry is not None:
                        both |= total[p] & carry
                        total[p] ^= carry
                    carry = both
                else:
                    if not carry.any():
                        break
                    both = total[p] & carry
                    total[p] ^= carry
                    carry = both
    return total


def select(total: list[np.ndarray], may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows surely among the k largest, rows tied at the border) as bitmaps (queries, words)."""
    sure = np.zeros_like(may)
    for bitmap in reversed(total):
        more = sure | (may & bitmap)
        n = np.bitwise_count(more).sum(axis=1)[:, None]
        sure = np.where(n <= k, more, sure)
        may = np.where(n > k, may & bitmap, np.where(n < k, may & ~bitmap, np.uint64(0)))
    return sure, may


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k best rows in one block."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    bitmaps, _ = slices(x)
    total = sums(bitmaps, q)
    may = np.zeros((len(q), bitmaps.shape[2] * 8), dtype=np.uint8)
    whole = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
    may[:, : len(whole)] = whole
    at = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    own = np.flatnonzero(ids[at] == query_ids)
    may[own, at[own] // 8] &= ~(1 << (at[own] % 8)).astype(np.uint8)
    sure, tied = select(total, may.view(np.uint64), k)
    if x.shape[1] * int(np.abs(x).max()) * int(np.abs(q).max()) >= 1 << 63:  # beyond 64-bit sums
        x, q = x.astype(object), q.astype(object)
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
        if len(rows) < k and tied[i].any():
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(tied[i].view(np.uint8), bitorder="little"))[: k - len(rows)]])
        out.append((np.full(len(rows), query_ids[i]), ids[rows], x[rows] @ q[i]))
    return [np.concatenate(c) for c in zip(*out)]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, rows: int = 8192, queries: int = 8192, abreast: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id `every` divides, the k largest inner products of floor(scale * x) with other rows.

    Rows and queries are dealt by hash to a grid of blocks of about `rows` by
    `queries`, of which `abreast` are added side by side; a cell gives k rows a
    query at most, and a window merges them.
    Unusable vectors take no part; vectors of different lengths don't meet. Of
    repeated vec_ids the smallest vector counts. Sums are exact at any width;
    scaled components of 2**62 and scores beyond a long raise an error.
    """
    whole = lambda v: F.when(F.abs(v * F.lit(scale)) < F.lit(2.0**62), F.floor(v * F.lit(scale)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component reaches 2**62")).cast("long"))
    values = one_each(vectors).select("vec_id", F.transform("vector", whole).alias("v")).withColumn("dim", F.size("v"))
    n = vectors.count()
    down, across = max(16, -(-n // rows)), max(1, -(-n // every // queries))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = values.select("dim", deal(down).alias("row"), spread(across).alias("col"), F.lit(False).alias("asks"), "vec_id", "v")
    right = values.where(F.col("vec_id") % every == 0).select("dim", spread(down).alias("row"), deal(across).alias("col"), F.lit(True).alias("asks"), "vec_id", "v")
    schema = "query_id long, vec_id long, score long"

    def cell(t: pa.Table) -> pa.Table:
        asks = np.array(t["asks"].to_pylist(), dtype=bool)
        ids = t["vec_id"].to_numpy().astype(np.int64)
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if asks.all() or not asks.any():
            found = [np.zeros(0, dtype=np.int64)] * 3
        else:
            who = np.flatnonzero(asks)
            parts = [best(ids[~asks], x[~asks], ids[some], x[some], k) for some in np.array_split(who, -(-len(who) // abreast))]
            found = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": pa.array(found[2].tolist(), type=pa.int64())})

    found = left.union(right).groupBy("dim", "row", "col").applyInArrow(cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
