"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoply.llm.common import saved
from duoply.operators.order import fresh

WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: list[int], cap: float, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[float]:
    """Target of each source: sum(sizes) by repeating weights, none above cap times its own size; what is above goes to the others by weight."""
    n = len(sizes)
    w = np.array([weights[i % len(weights)] for i in range(n)])
    own, total = np.array(sizes, dtype=float), float(sum(sizes))
    fixed, out = np.zeros(n, dtype=bool), np.zeros(n)
    while not fixed.all():
        left = total - cap * own[fixed].sum()
        out = np.where(fixed, cap * own, left * w / w[~fixed].sum())
        over = ~fixed & (out > cap * own)
        if not over.any():
            break
        fixed |= over
    return np.where(fixed, cap * own, out).tolist()


def size_of() -> Column:
    """The number of words of each whole text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, cap: int = 3, block: int = 512, max_sources: int = 1_000_000) -> DataFrame:
    """(source, doc_id, size, n_rows, source_size, target, rate, copies, extra), a row for each different (source, doc_id, size): each of its n_rows rows gets `copies` copies, and `extra` of them one more.

    Rates minimise the relative entropy of documents between 0 and `cap`
    copies to one copy each, under one constraint for each source: its expected
    words equal its target. The dual has one multiplier x for each source, and
    rate = cap / (1 + (cap - 1) * exp(-x * size / mean size)): one copy at
    x = 0, tilted exponentially elsewhere. Each Newton step sums value and
    slope by source over a table of (source, size, documents); brackets keep it
    near the solution. Rates become copies block by block, largest documents
    first: what rounding leaves over goes to the next document, so a block's
    error is about half of its smallest document.

    Sources are taken in code-point order, null last. Null and blank texts
    have size 0 and take nothing. Rows alike in all three columns are rounded
    row by row too, so their copies differ by one at most. The driver holds one
    row a source, at most `max_sources`: more are refused.
    """
    spark, known, key = docs.sparkSession, F.col("source").isNotNull(), F.coalesce("source", F.lit(""))
    rows_of = docs.select("source", "doc_id", size_of().alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n_rows"))
    light = saved(rows_of)
    table = saved(light.groupBy(known.alias("known"), key.alias("name"), "size").agg(F.sum("n_rows").alias("n")))
    totals = table.groupBy("known", "name").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    rows = sorted(totals.take(max_sources + 1), key=lambda r: (not r.known, r.name.encode()))
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    words, n_docs = np.array([r.words for r in rows], dtype=float), np.array([r.docs for r in rows], dtype=float)
    target = np.array(shares([r.words for r in rows], cap))
    mean = np.maximum(words / np.maximum(n_docs, 1), 1e-9)
    x, low, high = np.zeros(len(rows)), np.full(len(rows), -1e6), np.full(len(rows), 1e6)
    full = target >= cap * words * (1 - 1e-12)  # no freedom: every document as often as it may
    x[full] = 1e300
    close = 1e-9 * np.maximum(target, 1)
    schema = "known boolean, name string, x double, mean double, target double, source_size long, blocks long"

    def multipliers() -> DataFrame:
        """A row a source: broadcast up to 10,000 rows (under 1 MB), so that no task gets all rows of one source; joined by source beyond."""
        few = F.broadcast if len(rows) <= 10_000 else lambda df: df
        return few(spark.createDataFrame([(r.known, r.name, float(a), float(m), float(t), int(r.words), int(-(-r.docs // block))) for r, a, m, t in zip(rows, x, mean, target)], schema))

    tilt = F.exp(F.greatest(F.least(-F.col("x") * F.col("size") / F.col("mean"), F.lit(700.0)), F.lit(-700.0)))
    rate = F.lit(float(cap)) / (1 + (cap - 1) * tilt)
    at = {(r.known, r.name): i for i, r in enumerate(rows)}
    r, m = F.col("rate"), F.col("size") * F.col("n")
    for _ in range(60 if rows else 0):
        got, slope = np.zeros(len(rows)), np.zeros(len(rows))
        step = table.join(multipliers(), ["known", "name"]).withColumn("rate", rate).groupBy("known", "name")
        for s in step.agg(F.sum(m * r).alias("got"), F.sum(m * F.col("size") / F.col("mean") * r * (1 - r / cap)).alias("slope")).collect():
            got[at[s.known, s.name]], slope[at[s.known, s.name]] = s.got, s.slope
        off = got - target
        done = full | (np.abs(off) <= close)
        if done.all():
            break
        low, high = np.where(off < 0, x, low), np.where(off > 0, x, high)
        newton = x - off / np.maximum(slope, 1e-300)
        x = np.where(done, x, np.where((newton > low) & (newton < high), newton, (low + high) / 2))

    rated = light.withColumns({"known": known, "name": key}).join(multipliers(), ["known", "name"]).withColumn("rate", rate).withColumns({"copies": F.lit(0).cast("long"), "extra": F.lit(0).cast("long")})
    kind = dict(docs.dtypes)["doc_id"]
    salted = rated.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size"), "blocks"))
    out = ["source", "doc_id", "size", "n_rows", "source_size", "target", "rate", "copies", "extra"]

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True])
        left, taken = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n_rows"].tolist(), pdf["rate"].tolist()):
            want = rate * size * n + left
            taken.append(min(cap * n, max(0, int(want / size + 0.5))) if size else 0)
            left = want - taken[-1] * size
        taken = np.array(taken, dtype=np.int64)
        return pdf.assign(copies=taken // pdf["n_rows"].to_numpy(), extra=taken % pdf["n_rows"].to_numpy())[out]

    named = salted.withColumn("doc_id", F.col("doc_id").cast("string"))  # as text, ids beside a null keep all digits in pandas
    done = named.groupBy("known", "name", "_block").applyInPandas(rounded, named.select(out).schema)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def each_row(plan: DataFrame, most: int = 4096) -> DataFrame:
    """plan_mix() with a row for each row of the documents, whose own copies are in `copies`. Rows alike in many copies are made in runs of `most`, by as many tasks as there are runs."""
    runs = plan.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / F.lit(most)))))
    rows = runs.repartition(F.col("_run"), F.xxhash64("source", "doc_id", "size")).withColumn("_row", F.explode(F.sequence(F.col("_run") * most, F.least(F.col("n_rows"), (F.col("_run") + 1) * most) - 1)))
    return rows.withColumn("copies", F.col("copies") + (F.col("_row") < F.col("extra")).cast("long")).drop("_run", "_row", "extra", "n_rows")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """docs with each row as often as the mix takes it (see plan_mix).

    Of rows alike in source, doc_id and size, which ones get the additional
    copy is drawn by a hash of the row and its place in the input, so that no
    task must see all of them; their number is met on average.
    """
    kept, wanted = docs.columns, ("source", "doc_id", "size", "n_rows", "copies", "extra")
    size, place, copies, copy, *planned = fresh(kept, 4 + len(wanted))
    of = dict(zip(wanted, (F.col(c) for c in planned)))
    plan = plan_mix(docs, **settings).select(*(F.col(c).alias(p) for c, p in zip(wanted, planned)))
    same = [F.col(c).eqNullSafe(of[c]) for c in ("source", "doc_id")]
    draw = F.pmod(F.xxhash64("doc_id", "text", place), F.lit(1 << 30)) * of["n_rows"] < of["extra"] * F.lit(1 << 30)
    joined = docs.withColumns({place: F.monotonically_increasing_id(), size: size_of()}).join(plan, [*same, F.col(size) == of["size"]])
    each = joined.withColumn(copies, of["copies"] + F.when(of["extra"] > 0, draw.cast("long")).otherwise(0)).where(F.col(copies) > 0)
    return each.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(kept)
