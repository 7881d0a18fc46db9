"""Operator 13: against all pairs, with awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoply.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, v string, c0 long, cells string"


def plain(rows, positives=5, negatives=3, every=50, low=50, high=95):
    best: dict = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        x = [float(np.float32(c)) for c in x]
        if vec_id not in best or (x, label) < best[vec_id]:
            best[vec_id] = (x, label)
    v = {k: ([math.floor(256 * c) for c in x], label) for k, (x, label) in best.items()}
    out = []
    for a, (q, kind) in v.items():
        if a % every:
            continue
        score = {k: sum(m * n for m, n in zip(q, x)) for k, (x, _) in v.items() if k != a and len(x) == len(q)}
        first = lambda some, n: sorted(some, key=lambda k: (-score[k], k))[:n]
        for p in first([k for k in score if v[k][1] == kind], positives):
            may = [k for k in score if v[k][1] != kind and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(a, p, n, k, score[p], score[k]) for n, k in enumerate(first(may, negatives), 1)]
    return sorted(out)


def awkward():
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(3)) for k in range(0, 300)]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows += [(k, [c + rng.gauss(0, 0.05) for c in centres[k % 4]], k % 3) for k in range(300, 500)]
    rows += [(k, [0.5] * 6, k % 2) for k in range(500, 600)]  # copies: ties everywhere
    rows += [(k, [0.1, -0.2, 0.3], k % 2) for k in range(600, 660)] + [(700, [1.0], 1), (701, [0.9], 1), (702, [0.5], 2), (703, [], 1)]
    rows += [(50, [0.1] * 6, 9), (50, [0.2] * 6, 9), (None, [0.1] * 6, 1), (800, None, 1), (801, [None] * 6, 1), (802, [float("nan")] * 6, 1), (803, [float("inf")] * 6, 2), (804, [0.4] * 6, None), (-50, [0.3] * 6, -3), (850, [0.0] * 6, 1)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"sample": 40, "cell_rows": 8, "block": 16, "queries": 2}, {"sample": 0, "cell_rows": 4, "block": 50}])
def test_all_pairs(spark, sizes):
    rows = awkward()
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)
    label = F.col("label").cast("long")
    got = hardneg.mine(df, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label), **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert hardneg.mine(none).count() == 0
    assert hardneg.mine(spark.createDataFrame([(50, [1.0], 1, 1, "", 1, "")], SCHEMA)).count() == 0
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_hard_negatives(spark, str(tmp_path)).count() == 0


def test_bounds_hold_and_cells_come_in_their_order():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 4, (80, 8)) for c in rng.normal(0, 120, (12, 8))]).astype(np.int64)
    index = hardneg.Index(8, np.arange(len(v)), np.zeros(len(v)), v[::5], 10)
    codes, far = index.place(v)
    for (a, b), (x, y) in zip(codes.tolist(), far.tolist()):
        index.cells[(a, b)] = index.cells.get((a, b), 0) + 1
        index.radius[0][a], index.radius[1][b] = max(index.radius[0][a], x), max(index.radius[1][b], y)
    visited = []
    for anchor in v[:: len(v) // 40]:
        score, (one, two) = v @ anchor, index.bounds(anchor)
        for (a, b), s in zip(codes.tolist(), score.tolist()):
            assert one[0][a] + two[0][b] <= s <= one[1][a] + two[1][b]
        order = list(index.visit(anchor, -np.inf))
        upper = [one[1][a] + two[1][b] for a, b in order]
        assert sorted(order) == sorted(index.cells) and upper == sorted(upper, reverse=True)
        floor, ceiling = np.sort(score)[-20], np.sort(score)[-10]
        some = set(index.visit(anchor, floor, ceiling))
        assert all((a, b) in some for (a, b), s in zip(codes.tolist(), score.tolist()) if floor <= s <= ceiling)
        visited.append(len(some) / len(index.cells))
    assert np.mean(visited) < 0.5  # clusters: most cells are never read


def test_wide_scores():
    x, q = np.array([[1 << 40, 3], [-(1 << 40), 1 << 20]]), np.array([[1 << 21, -5]])
    assert hardneg.products(x, q).tolist() == [[(1 << 61) - 15, -(1 << 61) - 5 * (1 << 20)]]
    with pytest.raises(ValueError, match="fit a long"):
        hardneg.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
