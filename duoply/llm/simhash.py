"""SimHash near-dedup: multi-index hashing over fingerprint halves, then connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from duoply.llm.common import by_batch, saved
from duoply.operators.order import fresh

#: Shingles hashed at a time, and nodes that a task's forest holds before it passes its edges on.
BLOCK, NODES = 1 << 15, 1 << 18


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it; 0 without words."""
    rest, held, n, ones, digest = (text or "").encode().lower(), [], 0, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    while rest:
        parts = rest.split(None, BLOCK)
        rest = parts.pop() if len(parts) > BLOCK else b""
        here = held + parts
        some = max(len(here) - words + 1, 1 if here and not n and not rest else 0)
        if some > 0:
            ends = np.cumsum([len(p) + 1 for p in here]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
            ends = ends.tolist()
            view = memoryview(b" ".join(here))
            h = np.array([digest(view[s:e], seed) for s, e in zip(starts[:some], ends[words - 1 :] or ends[-1:])], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += some
        held = here[len(here) - words + 1 :] if len(here) >= words else here
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every whole text."""
    return marked(docs.select("text", "doc_id"), words)


def marked(rows: DataFrame, words: int) -> DataFrame:
    """rows (text and more columns) with fp in the place of the text."""

    def run(batch):
        fps = np.fromiter((fingerprint_of(x.as_py(), words) for x in batch.column(0)), dtype=np.int64, count=batch.num_rows)
        return {"fp": fps} | dict(zip(batch.schema.names[1:], batch.columns[1:]))

    return by_batch(rows, run, T.StructType([T.StructField("fp", T.LongType()), *rows.schema.fields[1:]]))


def links(fps: DataFrame, heavy: int = 256) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in 3 bits or fewer; fps has each once.

    Such a pair has a 32-bit half in which it differs by one bit at most. Every
    fingerprint is stored under both halves and looks up the ball of radius one
    around each; setting a bit is enough, because the other side sets it where
    this one has it. Complete distances are checked in the join. A half that
    more than `heavy` fingerprints share is looked up together with each byte
    of the other half, one of which must be equal. Those halves, at most
    len(fps) / 128, are the one table that may be broadcast: the balls are
    merged, as Spark takes them for no larger than fps, which they are 34 times.
    """
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    key = lambda side, value: value + F.lit(side << 32)
    index = fps.select("fp", F.explode(F.array(*(F.struct(key(i, h).alias("key"), halves[1 - i].alias("other")) for i, h in enumerate(halves)))).alias("x")).select("fp", "x.*")

    def ball(side: int):
        half, other = halves[side], halves[1 - side]
        unset = lambda i: (i < 0) | (F.call_function("shiftright", half, i).bitwiseAND(F.lit(1)) == 0)
        bit = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return F.transform(F.filter(F.sequence(F.lit(-1), F.lit(31)), unset), lambda i: F.struct(key(side, half + bit(i)).alias("key"), (i < 0).alias("same"), other.alias("other")))

    probes = fps.select("fp", F.explode(F.concat(ball(0), ball(1))).alias("x")).select("fp", "x.*")
    crowded = index.groupBy("key").count().where(F.col("count") > heavy).select(F.col("key").alias("_key"))

    def spread(df: DataFrame) -> DataFrame:
        part = F.when(F.col("_key").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(*(F.shiftright("other", 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * i) for i in range(4))))
        return df.join(crowded, F.col("key") == F.col("_key"), "left").withColumn("part", F.explode(part)).drop("_key", "other")

    a, b = spread(probes).withColumnRenamed("fp", "a"), spread(index).withColumnRenamed("fp", "b")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))
    return a.hint("merge").join(b.hint("merge"), ["key", "part"]).where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Each task first cuts its edges to a spanning forest. Then large-star and
    small-star rounds (Kiveris et al., 2014) run until nothing changes; each
    round is a written table, and a hub's neighbours are only minimised.
    """

    def forest(frames):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for f in frames:
            for x, y in zip(f.a.tolist(), f.b.tolist()):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
            if len(up) > NODES:
                yield pd.DataFrame([(x, y) for x in list(up) if (y := top(x)) != x], columns=["a", "b"])
                up.clear()
        yield pd.DataFrame([(x, y) for x in list(up) if (y := top(x)) != x], columns=["a", "b"], dtype="int64")

    now = saved(edges.mapInPandas(forest, "a long, b long").where("a is not null"))
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()  # each edge points to the smaller node
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now = saved(small.where("a != b").distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Null and blank texts have fingerprint zero and link like any other; long
    texts are hashed block by block. doc_id is a number. Rows
    with a null doc_id are linked only through the documents beside them, and
    have a null component if they stand alone. Copies meet in one class before
    anything is joined.
    """
    fps = saved(fingerprints(docs, words))
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = links(classes.where("first is not null").select("fp"))
    a, b = (classes.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in "ab")
    edges = pairs.join(a, "a").join(b, "b").select(F.col("a_first").cast("long").alias("a"), F.col("b_first").cast("long").alias("b"))
    found = components(edges)
    named = classes.join(found, F.col("first") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs.

    Groups are those of the texts: rows are linked by their fingerprints alone,
    so rows that share a doc_id but not a text are in different groups, each
    with a survivor, and rows without a doc_id are linked like all others. The
    row with the smallest doc_id stays, one without only if no row of the group
    has one; between rows of one doc_id the digest of the whole row decides.
    """
    cells = [c for name in docs.columns for c in (F.col(name).isNull(), F.col(name))]
    x, y = fresh([*docs.columns, "_x", "_y"], 2)
    named = docs.withColumns({x: F.xxhash64(F.lit(1), *cells), y: F.xxhash64(F.lit(2), *cells)})
    ranks = marked(named.select("text", F.col("doc_id").isNull().alias("none"), "doc_id", F.col(x).alias("_x"), F.col(y).alias("_y")), words)
    classes = saved(ranks.groupBy("fp").agg(F.min(F.struct("none", "doc_id", "_x", "_y")).alias("row")))
    pairs = links(classes.select("fp"))
    found = components(pairs)
    grouped = classes.join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("component"), "row")
    keep = grouped.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row._x").alias(x), F.col("row._y").alias(y))
    return named.join(keep, [x, y], "left_semi").dropDuplicates([x, y]).select(docs.columns)
