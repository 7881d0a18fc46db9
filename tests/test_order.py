"""Ordinals and other work that crosses ranges, against plain Python."""

import random
import statistics

import numpy as np
import pytest

from pyspark.sql import functions as F

from duoply.operators.detect import clusters_1d
from duoply.operators.order import clusters, followers, fresh, ordinals, quantiles


def test_fresh_names():
    assert fresh(["a", "_0", "_2"], 3) == ["_1", "_3", "_4"] and fresh([], 1) == ["_0"]


def test_ordinals_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(40), i, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id int, _0 string").repartition(7)
    got = ordinals(df, ["k"], [F.desc("v"), "id"], "n", partitions=9)
    want = {}
    for key in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got.columns == ["k", "v", "id", "_0", "n"] and {r.id: r.n for r in got.collect()} == want
    per_task = got.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count")).first()[0]
    assert per_task < 600  # two thirds of the rows have one key


def test_ordinals_of_equal_rows_and_without_key(spark):
    df = spark.createDataFrame([(1, None)] * 500 + [(2, "z")], "v int, w string").repartition(5)
    got = ordinals(df, [], ["v", "w"], "n", partitions=6).collect()
    assert sorted(r.n for r in got) == list(range(1, 502)) and next(r.n for r in got if r.v == 2) == 501
    assert ordinals(df.limit(0), ["w"], ["v"]).count() == 0


def test_clusters_cross_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([0.1, 0.2, 0.5, 0.9]) + rng.randrange(-3, 4) / 100) for _ in range(700)] + [("hot", None), ("one", 0.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = clusters(df, ["k"], "v", 0.02, partitions=11).collect()
    for key in ("hot", "b", None, "one"):
        values, cluster, want = sorted(v for k, v in rows if k == key and v is not None), 0, []
        for i, v in enumerate(values):
            cluster += i > 0 and v - values[i - 1] > 0.02
            want.append((v, cluster, i + 1))
        assert sorted((r.v, r.cluster, r.place) for r in got if r.k == key) == want
    centres = {(r.k, r.cluster): (r.n, r.centre) for r in clusters_1d(df, ("k",), "v", 0.02, least=1).collect()}
    for key in ("hot", "b", None, "one"):
        found = {}
        for r in got:
            if r.k == key:
                found.setdefault(r.cluster, []).append(r.v)
        for c, values in found.items():
            n, centre = centres[(key, c)]
            assert n == len(values) and abs(centre - statistics.median(values)) < 1e-12


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([None, 1.0, 2.5, 7.0, 100.0, rng.random()])) for _ in range(500)] + [("none", None), ("one", 4.0)]
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", {"low": 0.0, "mid": 0.5, "p90": 0.9}).collect()}
    for key in ("a", None, "one"):
        values = [v for k, v in rows if k == key and v is not None]
        assert [got[key].low, got[key].mid, got[key].p90] == [pytest.approx(np.quantile(values, q)) for q in (0, 0.5, 0.9)]
        assert got[key].n == sum(k == key for k, _ in rows)
    assert (got["none"].mid, got["none"].n) == (None, 1)


def test_followers_of_a_key_larger_than_a_task(spark):
    rng = random.Random(3)
    data = [(k, x, rng.random() < 0.1) for k in (None, "a", "b") for x in range(60)] + [("one", 0, True), ("none", 0, False), ("none", 1, False)]
    want = {}
    for k in {r[0] for r in data}:
        own = sorted(r[1:] for r in data if r[0] == k)
        for i, (x, _) in enumerate(own):
            want[k, x] = next((y for y, marked in own[i + 1 :] + own[:i] if marked), None)
    rows = spark.createDataFrame(data, "k string, x long, marked boolean")
    for partitions in (1, 7):
        got = followers(rows, ["k"], ["x"], F.when(F.col("marked"), F.col("x")), partitions=partitions)
        assert {(r.k, r.x): r.next for r in got.collect()} == want
