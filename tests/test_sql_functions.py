"""SQL names give what the column functions give; one text may call several."""

import random

from pyspark.sql import functions as F

from duoply.functions import moves as M
from duoply.functions import records as R
from duoply.functions import similarity as S
from duoply.functions import sql

TEXTS = ["Nf3", "Nbxd7+", "e8=Q#", "O-O", "0-0-0", "00", "o-o", "Pf4", "Pxf4", "cd", "cxd", "ch", "NxB", "e4xd5", "e2-e4", "e2e4", "??", "???", "", " ", None, "Qh4", "Rad1", "R1d1", "Kh1", "Bb5", "g4", "a4", "exd5", "gxh8=Q+", "N", "Nf33", "RK", "½"]


def test_the_same_as_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(x,) for x in TEXTS], "m string")
    pairs = {
        "normalize_move(m)": M.normalize_move, "parse_move(m)": M.parse_move, "notation_class(m)": M.notation_class, "is_truncated(m)": M.is_truncated, "move_complexity(m)": M.complexity,
        "normalize_result(m)": R.normalize_result, "person_key(m)": R.person_key,
    }
    rows = df.select("m", *(F.expr(t).alias(f"s{i}") for i, t in enumerate(pairs)), *(f(F.col("m")).alias(f"c{i}") for i, f in enumerate(pairs.values()))).collect()
    for r in rows:
        for i, t in enumerate(pairs):
            assert r[f"s{i}"] == r[f"c{i}"], (t, r.m)
    labels = spark.sql("SELECT ply_label(n) AS a, label_ply(ply_label(n)) AS b, label_ply('x') AS c, ply_of(3, 'Black') AS d FROM VALUES (0L), (7L) t(n)").collect()
    assert [tuple(r) for r in labels] == [("1.W", 0, None, 5), ("4.B", 7, None, 5)]


def test_pairs_are_the_same_as_columns(spark):
    sql.register(spark)
    rng = random.Random(1)
    rows = [(a, b) for a in TEXTS for b in TEXTS if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "a string, b string")
    pairs = {"move_similarity(a, b)": S.structured, "count_changes(a, b)": M.count_changes, "move_disagreement(a, b)": M.disagreement, "pair_key(a, b)": R.pair_key}
    for text, f in pairs.items():
        for r in df.select("a", "b", F.expr(text).alias("s"), f(F.col("a"), F.col("b")).alias("c")).collect():
            assert r.s == r.c or abs(r.s - r.c) < 1e-12, (text, r)


def test_rows_of_a_text(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "1. e4 {best} e5 2.Nf3 [x] Nc6 1-0"), (2, ""), (3, None), (4, " 1... e5 *")], "game_id int, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT game_id, m.ply, notation_class(m.move) AS kind, m.move FROM some_texts, LATERAL moves_from_text(text) m").collect()
    assert sorted((r.game_id, r.ply, r.move, r.kind) for r in got) == [(1, 0, "e4", "standard"), (1, 1, "e5", "standard"), (1, 2, "Nf3", "standard"), (1, 3, "Nc6", "standard"), (4, 0, "e5", "standard")]


def test_functions_run_once_a_text(spark):
    from duoply.plans.live import QUERIES

    plan = QUERIES["udf01_register_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [move") == 1 and plan.count("Aggregate [ply") == 1
