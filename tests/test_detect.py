"""Worked cases of rows within a game: marks, later readings of a piece, numbers; and results without rows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duoply import plans
from duoply.operators import align as A
from duoply.operators import detect as D
from duoply.operators import reconcile as J
from duoply.operators import review as V


def test_marks_that_the_board_denies(spark):
    rows = [(1, 1, 0, "e4+", True, False), (1, 1, 1, "Nf6", True, False), (1, 1, 2, "Bb5+", True, True), (1, 1, 3, "c6+", True, None), (1, 1, 4, "Qh5", False, None), (1, 1, 5, "Kd7+", True, False), (1, 2, 5, "Kd7+", True, False), (2, 1, 0, None, True, False)]
    c = spark.createDataFrame(rows, "game_id long, sheet int, ply long, move string, legal boolean, check boolean")
    assert sorted(map(tuple, D.flag_mismatch(c, "check").collect())) == [(1, 1, 0), (1, 2, 5)]
    assert D.flag_mismatch(c.limit(0), "check").count() == 0


def test_later_readings_against_a_loop(spark):
    moves = ["Bc4", "Bc5", "Bb5+", "Nf6", "Bd3", "Bd6", "e4", None, "Bc1", "Bb4", "e5", "Nd7"]
    conf = [0.9, 0.7, 0.85, 0.2, 0.71, None, 0.9, 0.8, 0.99, 0.86, 0.69, 0.7]
    rows = [(g, k, moves[(k * (g + 1)) % 12], conf[(k * (g + 2)) % 12]) for g in range(4) for k in range(12)]

    def kind(m):
        m = m or ""
        if m[:1] != "B":
            return m[:1] if m[:1] in "KQRN" and m[:1] else "P"
        at = m.rstrip("+")[-2:]
        return "B" + str((ord(at[0]) + int(at[1])) % 2)

    want = []
    for g, k, m, _ in rows:
        after = [(p, c) for h, p, n, c in rows if h == g and p > k and p % 2 == k % 2 and kind(n) == kind(m) and c is not None]
        sure = [p for p, c in after if c >= 0.7]
        want.append((g, k, len(sure), min(sure, default=None), [p for p, c in after if c >= 0.85]))
    got = J.future_piece_moves(spark.createDataFrame(rows, "game_id long, ply long, move string, conf double"))
    assert sorted(map(tuple, got.collect())) == want


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([("a", 9, 5), ("a", 2, 6), ("a", 4, 7), ("b", 1, 8), (None, 3, 9)], "g string, at int, i int")
    got = V.renumbered(rows.drop("i"), ["g"], [F.desc("at")]).orderBy(F.asc_nulls_first("g"), "i").collect()
    assert [tuple(r) for r in got] == [(None, 3, 0, 1, "w"), ("a", 9, 0, 1, "w"), ("a", 4, 1, 1, "b"), ("a", 2, 2, 2, "w"), ("b", 1, 0, 1, "w")]


@pytest.mark.parametrize("run", [A.align, A.gap_suggestions, A.cascade, lambda c: A.auto_apply(c, 0.5), lambda c: A.edited_cells(c, A.auto_apply(c, 0.5))])
def test_one_sheet_and_no_rows(spark, run):
    c = spark.createDataFrame([(1, 1, k, 0, f"e{k % 8 + 1}", 0.9, True) for k in range(12)], "game_id long, sheet int, ply long, rk int, move string, conf double, legal boolean")
    assert run(c.limit(0)).count() == 0
    rows = run(c).collect()
    if run is A.align:
        assert [(r["kind"], r["i"], r["j"]) for r in rows] == [("gap_s2", k, -1) for k in range(12)]


def test_a_mean_that_equals_the_limit_is_no_drop(spark):
    rows = [(1, p, x) for p, x in enumerate([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 6.8])] + [(2, p, x) for p, x in enumerate([6.79, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1])]
    rows += [(3, p, x) for p, x in enumerate([1.1, 1.3] * 4)] + [(4, p, x) for p, x in enumerate([0.63, 1.01, 1.77, 1.39, 0.85, 1.55, 1.2, 1.2])]
    got = D.overlap_drop(spark.createDataFrame(rows, "game_id long, ply long, overlap double"), below=1.2)
    assert [tuple(r) for r in got.collect()] == [(2, 0)]


def test_overlap_drop_adds_as_its_sql_does(spark, tmp_path):
    """Eight plies whose mean is 1.2 as decimals, and a little less as DuckDB adds them up; others, in which it isn't."""
    ids = {1: [432056, 432388, 433998, 436141, 436967, 440715, 441387, 442021], 2: list(range(432056, 432068)), 3: list(range(7, 1000, 41))}
    rows = [(e, pd.Timestamp(k, unit="s"), game, "click", 1.0) for game, of in ids.items() for k, e in enumerate(of)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    events.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    for t in ("orders", "customer", "lineitem", "embeddings"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.sql(plans.ORACLES["win05_overlap_drop"]).fetchall()
    assert (1, 0) in want and sorted(tuple(r) for r in plans.QUERIES["win05_overlap_drop"](spark, str(tmp_path)).collect()) == sorted(want)


def test_review_seconds_are_added_in_order_of_events(spark):
    seconds = [0.17, 0.23, 0.25, 0.18, 0.37, 0.3]  # 1.5 in this order, a little less in the other one
    total, back = 0.0, 0.0
    for x, y in zip(seconds, seconds[::-1]):
        total, back = total + x, back + y
    assert total >= 1.5 > back
    decisions = spark.createDataFrame([(1, k, k, "keep", 0, x) for k, x in enumerate(seconds)][::-1], "game_id long, event_id long, ply long, action string, session int, t_sec double").coalesce(1)
    games = spark.createDataFrame([(1, "A", 1, 1, 3, None, "verified")], "game_id long, section string, round int, board int, cells int, final_plies int, status string")
    none = lambda schema: spark.createDataFrame([], schema)
    report = V.game_report(games, decisions, none("game_id long, method string, ply long, san string, similarity double, status string"), none("game_id long, white_name string, black_name string, result string"), none("game_id long, seconds double"))
    assert report.first().review_seconds == 2


def test_groups_of_a_game_travel_as_arrow_tables(spark):
    c = spark.createDataFrame([(1, s, p, 0, "e4", 0.9) for s in (1, 2) for p in range(4)], "game_id long, sheet int, ply long, rk int, move string, conf double")
    for found in (A.align(c), A.cascade(c), A.auto_apply(c, 0.5), A.edited_cells(c, A.auto_apply(c, 0.5))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" in plan and "InPandas" not in plan
