"""Ordinals within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply.sources.shared import kept


def fresh(taken: list[str], n: int) -> list[str]:
    """n column names that none of the taken ones equals in any case of letters."""
    lower, out, k = {c.lower() for c in taken}, [], 0
    while len(out) < n:
        if (name := f"_{k}") not in lower:
            out.append(name)
        k += 1
    return out


def _ranged(rows: DataFrame, keys: list[str], order: list[str | Column], row: str, part: str, partitions: int | None) -> DataFrame:
    """rows with a number (row) and the range (part) of keys and order that they lie in; the numbers spread equal rows, and stand still once written."""
    laid = kept(rows.withColumn(row, F.monotonically_increasing_id()))
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(laid.repartitionByRange(count, *keys, *order, row).withColumn(part, F.spark_partition_id()))


def _joined(rows: DataFrame, sums: DataFrame, keys: list[str], part: str) -> DataFrame:
    """rows with what is known of their key and range; sums(keys, part, …) is one row for each."""
    same = fresh([*rows.columns, *sums.columns], len(keys) + 1)
    meet = F.col(part) == F.col(same[-1])
    for k, s in zip(keys, same):
        meet &= F.col(k).eqNullSafe(F.col(s))
    named = [F.col(k).alias(s) for k, s in zip(keys, same)] + [F.col(part).alias(same[-1])]
    return rows.join(sums.select(*named, *(c for c in sums.columns if c not in (*keys, part))), meet).drop(*same)


def ordinals(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """rows with their number (long, from 1) in the order of their key's rows. Keys may be null or none at all; rows that are equal in order get their numbers in any order.

    Rows are range-partitioned by keys and order, numbered within a range, and
    shifted by what earlier ranges hold of the same key, so a key may be larger
    than a task. The sizes that are summed are one row for each key and range.
    """
    row, part, n, before = fresh([*rows.columns, name], 4)
    ranged = _ranged(rows, keys, order, row, part, partitions)
    sizes = ranged.groupBy(*keys, part).agg(F.count("*").alias(n))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order, row))
    found = _joined(ranged.withColumn(row, rank), sizes.withColumn(before, ahead).drop(n), keys, part)
    return found.select(*rows.columns, (F.col(row) + F.col(before)).cast("long").alias(name))


def followers(rows: DataFrame, keys: list[str], order: list[str | Column], mark: Column, name: str = "next", partitions: int | None = None) -> DataFrame:
    """rows with the mark of the nearest row behind each one, in the order of its key's rows, that has one (isn't null); behind the last of them the key's first follows, but never a row itself.

    A range is run through once, backwards; what lies behind it is known from one
    row for each key and range, so a key may be larger than a task.
    """
    row, part, value, place, first, later, start, near = fresh([*rows.columns, name], 8)
    ranged = _ranged(rows.withColumn(value, mark), keys, order, row, part, partitions)
    w = Window.partitionBy(part, *keys)
    placed = ranged.withColumn(place, F.row_number().over(w.orderBy(*order, row)))
    placed = placed.withColumn(near, F.last(value, ignorenulls=True).over(w.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)))
    head = F.when(F.col(value).isNotNull(), F.struct(F.col(part).alias("part"), F.col(place).alias("place"), F.col(value).alias("value")))
    ends = placed.groupBy(*keys, part).agg(F.min_by(head, F.when(F.col(value).isNotNull(), F.col(place))).alias(first))
    by_key = Window.partitionBy(*keys)
    ends = ends.withColumns({later: F.last(first, ignorenulls=True).over(by_key.orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)), start: F.first(first, ignorenulls=True).over(by_key.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).drop(first)
    found = _joined(placed, ends, keys, part)
    own = F.col(start)["part"].eqNullSafe(F.col(part)) & F.col(start)["place"].eqNullSafe(F.col(place))
    return found.select(*rows.columns, F.coalesce(near, F.col(later)["value"], F.when(~own, F.col(start)["value"])).alias(name))


def clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float, name: str = "cluster", place: str = "place", partitions: int | None = None) -> DataFrame:
    """rows whose value isn't null with the number of their cluster (long, from 0) and their place in the order of their key's values (long, from 1): a new cluster begins where the gap to the value before exceeds the tolerance.

    Gaps are counted within ranges of keys and value; a range's borders with
    those before and after are stitched from one row for each key and range, so
    a key, and a cluster, may be larger than a task.
    """
    row, part, n, low, high, jumps, border, ahead, offset = fresh([*rows.columns, name, place], 9)
    ranged = _ranged(rows.where(F.col(value).isNotNull()), keys, [value], row, part, partitions)
    w = Window.partitionBy(part, *keys).orderBy(value, row)
    jump = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("long"), F.lit(0))
    local = ranged.withColumn(jumps, jump).withColumns({name: F.sum(jumps).over(w), place: F.row_number().over(w)}).drop(jumps)
    ends = local.groupBy(*keys, part).agg(F.count("*").alias(n), F.min(value).alias(low), F.max(value).alias(high), F.max(name).alias(jumps))
    by_key = Window.partitionBy(*keys).orderBy(part)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(border, F.coalesce((F.col(low) - F.lag(high).over(by_key) > tolerance).cast("long"), F.lit(0)))
    ends = ends.withColumns({ahead: F.coalesce(F.sum(n).over(earlier), F.lit(0)), offset: F.coalesce(F.sum(jumps).over(earlier), F.lit(0)) + F.sum(border).over(by_key)})
    found = _joined(local, ends.select(*keys, part, ahead, offset), keys, part)
    return found.select(*rows.columns, (F.col(name) + F.col(offset)).alias(name), (F.col(place) + F.col(ahead)).cast("long").alias(place))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], count: str = "n") -> DataFrame:
    """(keys, a column for each of shares, count of rows): exact quantiles of the non-null values of each key, between neighbours by their distance; count takes in null values. From ordinals(), so a key's values needn't meet in one task; two rows a share are picked by place."""
    place, at, total = fresh([*rows.columns, *shares, count], 3)
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(count), F.count(value).alias(total))
    placed = ordinals(known, keys, [value], place)
    same = fresh([*placed.columns, count, total], len(keys))
    meet = F.lit(True)
    for k, s in zip(keys, same):
        meet &= F.col(k).eqNullSafe(F.col(s))
    both = sizes.select(*(F.col(k).alias(s) for k, s in zip(keys, same)), count, total).join(placed, meet, "left")
    position = {q: share * (F.col(total) - 1) + 1 for q, share in shares.items()}

    def between(q: str) -> Column:
        low, high = F.floor(position[q]), F.ceil(position[q])
        pick = lambda p: F.max(F.when(F.col(place) == p, F.col(value)))
        return (pick(low) + (pick(high) - pick(low)) * F.max(position[q] - low)).alias(q)

    return both.groupBy(*(F.col(s).alias(k) for k, s in zip(keys, same)), count).agg(*(between(q) for q in shares)).select(*keys, *shares, count)
