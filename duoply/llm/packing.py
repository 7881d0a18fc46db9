"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed length.

Pieces are placed class by class, long ones first. A round range-sorts the
pieces of a class and the gaps of all sequences together, by size downward. Each
task sweeps its range: a piece takes the smallest gap that holds it and that no
longer piece has taken (the nearest one in front that is still free). What a
range can't match in itself is ranked, and ranks decide which gap of an earlier
range a piece gets: from the number of left pieces and gaps of each range, a
stack tells the spans of ranks that meet, and pieces and gaps join by range and
rank. Then gaps are updated, and the round is repeated with what is left; where
gaps take no more, new sequences are opened. Rounds are written tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoply.llm.bpe import compiled
from duoply.llm.common import by_batch, saved

#: Classes end at these fractions of a sequence; pieces of the first ones are so long that it is known how many a sequence holds.
CLASSES, KNOWN = (1, 2, 3, 4, 8, 32), 3
#: Rows that a task sweeps, about. A class with fewer pieces left than this part of all gets as many sequences as are surely enough.
ROWS, TAIL = 50_000, 200
#: What an item of a sweep is: a gap, a piece, or a gap too small for the class, which is only passed on.
GAP, PIECE, SMALL = 0, 1, 2


def pieces(docs: DataFrame, path: str, room: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and end_id; only longer ones are cut, and the first piece takes what is over. A worker holds the ids of a few megabytes of texts, or of one longer text."""

    def run(batch):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(batch.column(0).to_pylist(), compiled(path).ids(batch.column(1).to_pylist())):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for name, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                    out[name].append(v)
        return out

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def matched(size: np.ndarray, is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, mate): rows by size downward, gaps before pieces of their size; and for each place in that order the place of the gap or piece it meets, or -1. Pieces and gaps meet like brackets, so left pieces stand before left gaps."""
    order = np.lexsort((is_piece, -size))
    closes = is_piece[order]
    level = np.cumsum(1 - 2 * closes) + closes
    at = np.argsort(level, kind="stable")
    mate = np.full(len(order), -1, dtype=np.int64)
    if len(order):
        meets = (level[at][1:] == level[at][:-1]) & (closes[at][1:] == 1)  # levels are crossed up and down in turn
        a, b = at[:-1][meets], at[1:][meets]
        mate[a], mate[b] = b, a
    return order, mate


SWEPT = "range int, rank long, seq long, id long, length long, gap long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (size, kind, key) of one range -> SWEPT: gaps with the piece they took, and ranked gaps and pieces that are left."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    size, kind, key = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
    small = kind == SMALL
    order, mate = matched(size[~small], kind[~small])
    more = [x[small] for x in (size, key)]
    size, kind, key = (x[~small][order] for x in (size, kind, key))
    gap, left = np.flatnonzero(kind == GAP), np.flatnonzero((kind == PIECE) & (mate < 0))
    took = mate[gap]
    rank = np.zeros(len(gap), dtype=np.int64)
    rank[took < 0] = np.arange(1, (took < 0).sum() + 1)
    none = lambda n: pa.nulls(n, pa.int64())
    here = TaskContext.get().partitionId()
    for columns in (
        (pa.array(rank, mask=took >= 0), key[gap], pa.array(key[took], mask=took < 0), pa.array(size[took], mask=took < 0), size[gap] - np.where(took >= 0, size[took], 0)),
        (np.arange(1, len(left) + 1), none(len(left)), key[left], size[left], none(len(left))),
        (none(len(more[0])), more[1], none(len(more[0])), none(len(more[0])), more[0]),
    ):
        if n := len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, here, dtype=np.int32)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["range", "rank", "seq", "id", "length", "gap"])


def spans(pieces_left: dict[int, int], gaps_left: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range of pieces, first rank, last rank, range of gaps, sum of ranks that meet), from the numbers of left pieces and gaps of each range: a piece meets the last free gap of the ranges before."""
    out, stack = [], []
    for r in sorted({*pieces_left, *gaps_left}):
        n, rank = pieces_left.get(r, 0), 1
        while n and stack:
            of, free = stack[-1]
            some = min(n, free)
            out.append((r, rank, rank + some - 1, of, free + rank))
            rank, n = rank + some, n - some
            stack[-1][1] -= some
            if not stack[-1][1]:
                stack.pop()
        if gaps_left.get(r):
            stack.append([r, gaps_left[r]])
    return out


def round_of(left: DataFrame, gaps: DataFrame, high: int, low: int, tasks: int) -> DataFrame:
    """One round: pieces `left` (id, length) of a class (low, high] and gaps (seq, gap), in several rows a sequence -> (seq, id, length, gap): gaps with what they took and keep, and pieces without a gap.

    A gap with room for several pieces of the class takes part as several gaps,
    which are one again in the next round. So few rows that one task sweeps them
    are brought to it at once; then nothing is left to match across ranges.
    """
    together = (lambda df: df.repartition(1)) if tasks == 1 else (lambda df: df)
    whole = together(gaps).groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0")
    many = F.when(F.col("gap") > low, F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / high))).otherwise(1)
    part = F.when(F.col("_part") + 1 < many, F.lit(high).cast("long")).otherwise(F.col("gap") - (many - 1) * high)
    split = whole.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).select(part.alias("size"), F.when(F.col("gap") > low, GAP).otherwise(SMALL).alias("kind"), F.col("seq").alias("key"))
    items = split.union(together(left).select("length", F.lit(PIECE), "id"))
    if tasks == 1:
        return saved(items.coalesce(1).mapInArrow(sweep, SWEPT).select("seq", "id", "length", "gap"))
    swept = saved(items.repartitionByRange(tasks, F.desc("size"), F.asc("kind"), F.xxhash64("key")).mapInArrow(sweep, SWEPT))
    counts = swept.where("rank is not null").groupBy("range", F.col("seq").isNull().alias("is_piece")).agg(F.max("rank").alias("n")).collect()  # two rows a task at most
    meet = spans({r["range"]: r.n for r in counts if r.is_piece}, {r["range"]: r.n for r in counts if not r.is_piece})
    meet = F.broadcast(left.sparkSession.createDataFrame(meet, "_of int, _first long, _last long, _range int, _sum long"))
    open_ = swept.where("seq is null").join(meet, (F.col("range") == F.col("_of")) & F.col("rank").between(F.col("_first"), F.col("_last")), "left")
    taking = open_.where("_range is not null").select("_range", (F.col("_sum") - F.col("rank")).alias("_rank"), F.col("id").alias("_id"), F.col("length").alias("_length"))
    free = swept.where("seq is not null and rank is not null").join(taking, (F.col("range") == F.col("_range")) & (F.col("rank") == F.col("_rank")), "left")
    return saved(
        swept.where("seq is not null and rank is null").select("seq", "id", "length", "gap")
        .union(free.select("seq", F.col("_id"), F.col("_length"), F.col("gap") - F.coalesce("_length", F.lit(0))))
        .union(open_.where("_range is null").select("seq", "id", "length", "gap"))
    )


def fill(pieces: DataFrame, room: int) -> DataFrame:
    """(id, seq): the sequence of each piece (id, length). Ids are unique, lengths lie between 1 and room. The driver holds a few numbers for each class and task."""
    spark = pieces.sparkSession
    ends = [*dict.fromkeys(max(1, room // c) for c in CLASSES if c <= room), 0]
    class_of = sum((F.col("length") <= e).cast("int") for e in ends[1:-1]) if len(ends) > 2 else F.lit(0)
    sizes = {r["class"]: (r.n, r.words) for r in pieces.groupBy(class_of.alias("class")).agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()}
    total = sum(n for n, _ in sizes.values())
    gaps, used, placed = spark.createDataFrame([], "seq long, gap long"), 0, []
    for k, (high, low) in enumerate(zip(ends, ends[1:])):
        n, words = sizes.get(k, (0, 0))
        left, tried = pieces.where((F.col("length") > low) & (F.col("length") <= high)).select("id", "length"), not used
        while n:
            if tried:  # the gaps there are take few more
                new = -(-n // (room // high)) if k < KNOWN or n * TAIL < total or n < 64 else -(-words // room)
                gaps = gaps.union(spark.range(used, used + new, 1, -(-new // ROWS)).select(F.col("id").alias("seq"), F.lit(room).cast("long").alias("gap")))
                used += new
            state = round_of(left, gaps, high, low, -(-(n + used) // ROWS))
            placed.append(state.where("seq is not null and id is not null").select("id", "seq"))
            gaps = state.where("seq is not null").select("seq", "gap")
            left = state.where("seq is null").select("id", "length")
            before, (n, words) = n, left.agg(F.count("*"), F.sum("length")).first()
            tried = before <= 2 * n
    found = spark.createDataFrame([], "id long, seq long")
    for some in placed:
        found = found.union(some)
    return found


def pack(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows of docs.

    A null text is an empty one: only end_id. Repeated rows are packed each.
    Rows with a null doc_id, or with the same one, are documents like others;
    further columns are not read. Pieces and their sequences are merged: as
    Parquet they take a fraction of their memory, by which Spark would broadcast.
    """
    cut = saved(pieces(docs, path, room, end_id).withColumn("_id", F.monotonically_increasing_id()))
    found = fill(cut.select(F.col("_id").alias("id"), "length"), room)
    behind = Window.partitionBy("seq").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.hint("merge").join(found, F.col("_id") == F.col("id")).withColumn("offset", F.coalesce(F.sum("length").over(behind), F.lit(0)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
