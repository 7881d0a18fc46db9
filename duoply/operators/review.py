"""Comparison of repair methods, triage, and reviewer analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply import config as C
from duoply.config import METHOD_ORDER
from duoply.functions.moves import ply_label
from duoply.operators.detect import clusters_1d
from duoply.operators.order import followers, ordinals, quantiles

PLACE = {m: i for i, m in enumerate(METHOD_ORDER)}


def method_place():
    return F.element_at(F.create_map(*(F.lit(x) for kv in PLACE.items() for x in kv)), F.col("method"))


def statuses(fixes: DataFrame) -> DataFrame:
    """(game_id, method, status, n): one status a game and method."""
    return fixes.groupBy("game_id", "method").agg(F.max("status").alias("status"), F.count("*").alias("n"))


def compare_methods(fixes: DataFrame) -> DataFrame:
    """(game_id, methods, agreements, disagreements, total, min_similarity): plies on which every method proposes the same move; one trailing + or # is ignored, of several fixes of a ply the largest counts."""
    one = fixes.groupBy("game_id", "method", "ply").agg(F.max(F.regexp_replace("san", "[+#]$", "")).alias("san"))
    methods = fixes.groupBy("game_id").agg(F.count_distinct("method").alias("methods"), F.min(method_place()).alias("first"))
    plies = one.groupBy("game_id", "ply").agg(F.count("*").alias("n"), F.count_distinct("san").alias("d")).join(methods, "game_id")
    same = (F.col("n") == F.col("methods")) & (F.col("d") == 1)
    counts = plies.groupBy("game_id", "methods", "first").agg(F.count_if(same).alias("agreements"), F.count_if(~same).alias("disagreements"), F.count("*").alias("total"))
    similarity = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    least = fixes.groupBy("game_id", method_place().alias("first")).agg(F.min(similarity).alias("min_similarity"))
    return counts.join(least, ["game_id", "first"], "left").drop("first")


def triage(fixes: DataFrame) -> DataFrame:
    """(game_id, tier, reason): C unless every method solved it; A without disagreement, with few and close fixes; B for a little more."""
    solved = statuses(fixes).groupBy("game_id").agg(F.bool_and(F.col("status") == "SOLVED").alias("solved"))
    c = compare_methods(fixes).join(solved, "game_id")
    a = (F.col("disagreements") == 0) & (F.col("total") <= 5) & (F.col("min_similarity") >= 0.7)
    b = (F.col("disagreements") <= 2) & (F.col("total") <= 12)
    tier = F.when(~F.col("solved"), "C").when(a, "A").when(b, "B").otherwise("C")
    reason = F.when(~F.col("solved"), "not_solved").when(a, "agreed").when(b, "minor").when(F.col("disagreements") > 2, "disagree").otherwise("many_fixes")
    return c.select("game_id", tier.alias("tier"), reason.alias("reason"))


def pick_best(fixes: DataFrame) -> DataFrame:
    """(game_id, method, status): the first solved or valid method in order, else the first partial one with a fix."""
    rank = F.when(F.col("status").isin("SOLVED", "VALID"), 0).when((F.col("status") == "PARTIAL") & (F.col("n") > 0), 1)
    order = Window.partitionBy("game_id").orderBy("rank", "place")
    s = statuses(fixes).withColumns({"rank": rank, "place": method_place()}).where("rank is not null")
    return s.withColumn("k", F.row_number().over(order)).where("k = 1").select("game_id", "method", "status")


def game_report(games: DataFrame, decisions: DataFrame, fixes: DataFrame, pairings: DataFrame, attention: DataFrame) -> DataFrame:
    """One row a game, as reports list it.

    games(game_id, section, round, board, cells, final_plies, status),
    decisions(game_id, ply, action, session, t_sec; with event_id seconds are
    added in its order, so that halves are rounded alike in all runs), fixes as for triage(),
    pairings(game_id, white_name, black_name, result), attention(game_id,
    seconds). Moves are the confirmed plies if known, else those of the picked
    method; counts are 0 and texts empty where nothing is known.
    """
    of = lambda a: F.count_if(F.col("action") == a)
    spent = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("t_sec").isNotNull(), F.struct("event_id", "t_sec")))), F.lit(0.0), lambda total, x: total + x["t_sec"]) if "event_id" in decisions.columns else F.sum("t_sec")
    seen = decisions.groupBy("game_id").agg(of("override").alias("user_overrides"), of("confirm").alias("confirmations"), of("keep").alias("keeps"), of("edit").alias("review_edits"), F.count_distinct("ply").alias("surfaced_decisions"), F.round(spent).cast("long").alias("review_seconds"), F.count_distinct("session").alias("review_sessions"))
    last = fixes.groupBy("game_id", "method").agg(F.max("ply").alias("plies"), F.count("*").alias("algorithm_fixes"))
    picked = pick_best(fixes).join(last, ["game_id", "method"]).select("game_id", "plies", "algorithm_fixes")
    open_ = attention.select("game_id", F.round("seconds").cast("long").alias("attention_seconds"))
    row = games.join(pairings, "game_id", "left").join(picked, "game_id", "left").join(seen, "game_id", "left").join(open_, "game_id", "left").join(triage(fixes), "game_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return row.select(
        "game_id", text("section", "section"), "round", "board", text("white_name", "white"), text("black_name", "black"), text("result", "result"), F.coalesce(F.nullif("final_plies", F.lit(0)), "plies", F.lit(0)).alias("total_moves"), F.coalesce("cells", F.lit(0)).alias("ocr_cells"),
        *map(count, ("algorithm_fixes", "user_overrides", "confirmations", "keeps", "review_edits", "surfaced_decisions", "review_seconds", "attention_seconds", "review_sessions")), text("tier", "tier"), text("reason", "triage_reason"), text("status", "status"),
    )


def decision_log(games: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each of a reviewer's actions: (game_id, round, board, ply, move, action, ocr, proposed, final_san, method, session, t_sec); move is the label of the ply (12.W), texts that aren't known are empty. games(game_id, round, board), decisions(game_id, ply, action, ocr, proposed, final_san, method, session, t_sec); actions of unknown games are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    label = F.coalesce(ply_label(F.col("ply")), F.lit("")).alias("move")
    d = decisions.join(games.select("game_id", "round", "board"), "game_id")
    return d.select("game_id", "round", "board", "ply", label, *map(text, ("action", "ocr", "proposed", "final_san", "method", "session")), "t_sec")


def latency(decisions: DataFrame) -> DataFrame:
    """(action, p50, p90, n): how long decisions took, by action; exact at any size (operators.order.quantiles)."""
    return quantiles(decisions, ["action"], "t_sec", {"p50": 0.5, "p90": 0.9})


def confusion(decisions: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Readings by final text, counted."""
    return decisions.groupBy("ocr").pivot("final_san", list(values)).count().fillna(0)


def grid_consensus(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(layout, bucket, place, x): column positions that sheets of a layout and aspect share.

    cells(sheet_id, x_frac), sheets(sheet_id, layout, aspect, taken). Of the last
    few sheets with two columns or more, the most frequent number of columns
    (the smaller of equals) counts; positions are medians over its sheets.
    """
    columns = clusters_1d(cells, ("sheet_id",), "x_frac", C.COLUMN_GAP, C.CLUSTER_CELLS)
    by_sheet = Window.partitionBy("sheet_id")
    placed = columns.withColumns({"place": F.row_number().over(by_sheet.orderBy("centre")), "n": F.count("*").over(by_sheet)}).where("n >= 2").select("sheet_id", "place", "n", "centre")
    bucket = F.floor(F.col("aspect") / C.ASPECT_STEP + 0.5).cast("long")
    key = ["layout", "bucket"]
    used = placed.select("sheet_id", "n").distinct().join(sheets.withColumn("bucket", bucket), "sheet_id")
    last = used.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"), F.desc("sheet_id")))).where(F.col("_r") <= C.SAMPLES_KEPT)
    most = last.groupBy(*key, "n").agg(F.count("*").alias("k")).withColumns({"_all": F.sum("k").over(Window.partitionBy(*key)), "_r": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("k"), "n"))})
    most = most.where((F.col("_r") == 1) & (F.col("_all") >= C.SAMPLES_NEEDED) & (F.col("k") >= C.SAMPLES_NEEDED)).select(*key, "n")
    return last.join(most, [*key, "n"]).select(*key, "sheet_id").join(placed, "sheet_id").groupBy(*key, "place").agg(F.median("centre").alias("x"))


def row_alignment(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, row_difference, deviation, aligned, confidence) for pairs(left_id, right_id) of sheets; cells(sheet_id, y) in pixels. Rows are clusters of y; those of both sheets are compared in order."""
    rows = clusters_1d(cells, ("sheet_id",), "y", C.ROW_GAP, 1, "mean").withColumn("k", F.row_number().over(Window.partitionBy("sheet_id").orderBy("centre")))
    counts = rows.groupBy("sheet_id").agg(F.count("*").alias("n"))
    side = lambda name: counts.select(F.col("sheet_id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    at = lambda name: rows.select(F.col("sheet_id").alias(f"{name}_id"), "k", F.col("centre").alias(f"{name}_y"))
    gaps = pairs.join(at("left"), "left_id").join(at("right"), ["right_id", "k"]).groupBy("left_id", "right_id").agg(F.avg(F.abs(F.col("left_y") - F.col("right_y"))).alias("deviation"))
    difference = F.abs(F.col("left_n") - F.col("right_n"))
    near = difference <= C.ROW_COUNTS
    return both.join(gaps, ["left_id", "right_id"]).select("left_id", "right_id", difference.alias("row_difference"), "deviation", (near & (F.col("deviation") < C.ROW_DEVIATION)).alias("aligned"), F.when(near, F.greatest(F.lit(0.0), 1 - F.col("deviation") / 50)).otherwise(0.3).alias("confidence"))


def renumbered(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows with i (from 0, in order within keys), num and color: the full move and side of the i-th half-move."""
    i = F.col("i")
    placed = rows.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    return placed.withColumns({"num": F.floor(i / 2) + 1, "color": F.when(i % 2 == 0, "w").otherwise("b")})


def shifted_plies(plies, at, op):
    """A list of plies after an insert or delete at a ply."""
    kept = F.when(op == "delete", F.filter(plies, lambda p: p != at)).otherwise(plies)
    return F.transform(kept, lambda p: F.when((op == "delete") & (p > at), p - 1).when((op == "insert") & (p >= at), p + 1).otherwise(p))


def shifted_frontier(frontier, at, op):
    """The number of confirmed plies after an insert or delete at a ply; none stay none."""
    moved = F.when((op == "delete") & (frontier > at), frontier - 1).when((op == "insert") & (frontier >= at), frontier + 1).otherwise(frontier)
    return F.when(frontier <= 0, frontier).otherwise(moved)


def work_order(games: DataFrame, keys: list[str], order: list) -> DataFrame:
    """games with place: their number within keys in the given order (operators.order.ordinals), so a key's games needn't meet in one task."""
    return ordinals(games, keys, order)


def next_item(games: DataFrame, keys: list[str], order: list, wanted) -> DataFrame:
    """games with next_id: the game_id of the next wanted game behind each one in its key's order, going on from the first; never itself (operators.order.followers), so a key's games needn't meet in one task."""
    return followers(games, keys, order, F.when(wanted, F.col("game_id")), "next_id")
