"""Row-ordered detection inside a game: windows over (game_id, sheet) by ply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoply import config as C
from duoply.operators.order import clusters
from duoply.functions.moves import complexity, disagreement, normalize_move


def by_ply():
    return Window.partitionBy("game_id").orderBy("ply")


def by_sheet():
    return Window.partitionBy("game_id", "sheet").orderBy("ply")


def backward():
    return Window.partitionBy("game_id", "sheet").orderBy(F.desc("ply"))


def runs(df: DataFrame, flag: str, keys: tuple[str, ...], order: str = "ply") -> DataFrame:
    """df with island, a number that changes whenever flag does."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int")
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def overlap_drop(scores: DataFrame, window: int = C.DROP_WINDOW, below: float = C.DROP_BELOW, digits: int | None = 9) -> DataFrame:
    """(game_id, start): first even start of a window whose mean overlap, at nine digits (a mean that equals the limit isn't below it), is too low. Without digits the mean counts as it comes from adding up by ply. scores(game_id, ply, overlap), null for blank plies."""
    w = by_ply().rowsBetween(0, window - 1)
    mean = F.coalesce(F.avg("overlap").over(w), F.lit(0.0))
    s = scores.withColumns({"i": F.row_number().over(by_ply()) - 1, "mean": mean if digits is None else F.round(mean, digits), "n": F.count("*").over(w)})
    return s.where((F.col("n") == window) & (F.col("i") % 2 == 0) & (F.col("mean") < below)).groupBy("game_id").agg(F.min("ply").alias("start"))


def isolated_dropout(scores: DataFrame) -> DataFrame:
    """(game_id, start): first run of 2-6 plies without overlap between four well-matched plies on either side."""
    low = scores.withColumn("low", F.col("overlap") < C.DROPOUT_BELOW)
    n = C.DROPOUT_ANCHORS
    sides = {"before": by_ply().rowsBetween(-n, -1), "after": by_ply().rowsBetween(1, n)}
    low = low.withColumns({k: F.when(F.count("*").over(w) == n, F.min("overlap").over(w)) for k, w in sides.items()})
    isles = runs(low, "low", ("game_id",)).where("low").groupBy("game_id", "island").agg(F.min("ply").alias("start"), F.count("*").alias("n"), F.min_by("before", "ply").alias("before"), F.max_by("after", "ply").alias("after"))
    good = F.col("n").between(*C.DROPOUT_LENGTH) & (F.col("before") >= C.DROPOUT_ANCHOR) & (F.col("after") >= C.DROPOUT_ANCHOR)
    return isles.where(good).groupBy("game_id").agg(F.min("start").alias("start"))


def disagreement_runs(tops: DataFrame) -> DataFrame:
    """(game_id, start, n, strong, mean_ratio, level): long runs of plies on which the readers differ. tops(game_id, ply, m1, m2)."""
    t = tops.where("m1 is not null and m2 is not null")
    t = t.withColumns({"off": normalize_move(F.col("m1")) != normalize_move(F.col("m2")), "ratio": disagreement(F.col("m1"), F.col("m2"))})
    found = runs(t, "off", ("game_id",)).where("off").groupBy("game_id", "island").agg(F.min("ply").alias("start"), F.count("*").alias("n"), F.count_if(F.col("ratio") >= C.STRONG_RATIO).alias("strong"), F.avg("ratio").alias("mean_ratio"))
    level = F.when(F.col("strong") >= 10, "high").when(F.col("strong") >= 5, "medium").otherwise("low")
    return found.where((F.col("n") >= C.RUN_LEAST) & (F.col("strong") >= C.RUN_STRONG)).withColumn("level", level).drop("island")


def valid_prefix(c: DataFrame, flag: str = "legal") -> DataFrame:
    """Rows of each game and sheet before the first row whose flag is false."""
    return c.withColumn("_bad", F.max((~F.col(flag)).cast("int")).over(by_sheet())).where("_bad = 0").drop("_bad")


def flag_mismatch(rows: DataFrame, truth: str, mark: str = "+", valid: str = "legal") -> DataFrame:
    """(game_id, sheet, ply) of moves in each sheet's valid prefix that are written with the mark although the column truth is false; where truth is null nothing is known, and nothing is told."""
    return valid_prefix(rows, valid).where(F.col("move").contains(mark) & ~F.col(truth)).select("game_id", "sheet", "ply")


def classify_tiers(merged: DataFrame) -> DataFrame:
    """(game_id, ply, tier) of merged rows with a flag legal: 3 from the first stop on; 1 for agreement of two sheets; else 2."""
    stop = (F.col("ambiguous") | ~F.col("legal")).cast("int")
    tier = F.when(F.max(stop).over(by_ply()) == 1, 3).when((F.col("sheet_count") == 2) & (F.col("agree") | F.col("consensus")), 1).otherwise(2)
    return merged.select("game_id", "ply", tier.alias("tier"))


#: Tiers that a mode locks (fixed values).
LOCKS = {"none": (), "tier1": (1,), "tier1+2": (1, 2)}


def locked_plies(tiers: DataFrame, mode: str) -> DataFrame:
    """(game_id, ply) that may no longer change, of tiers(game_id, ply, tier), under a mode of LOCKS."""
    return tiers.where(F.col("tier").isin(*LOCKS[mode]) if LOCKS[mode] else F.lit(False)).select("game_id", "ply")


def simple_tail_noise(tops: DataFrame) -> DataFrame:
    """(game_id, sheet, start): conservative start of tail noise: 4 or more trailing weak readings; else a move 4 times in the last 6; else a weak mean of the last 4 with 3 trailing weak ones."""
    t = tops.withColumn("back", F.row_number().over(backward())).withColumn("weak", F.col("conf") < 0.40)
    t = t.withColumn("strong_seen", F.max((~F.col("weak")).cast("int")).over(backward()))
    per = t.groupBy("game_id", "sheet").agg(
        F.count_if(F.col("strong_seen") == 0).alias("trail"), F.min(F.when(F.col("strong_seen") == 0, F.col("ply"))).alias("trail_start"),
        F.avg(F.when(F.col("back") <= 4, F.col("conf"))).alias("mean4"), F.count("*").alias("n"),
    )
    often = t.where("back <= 6").groupBy("game_id", "sheet", "move").agg(F.count("*").alias("k"), F.min("ply").alias("first")).where("k >= 4").select("game_id", "sheet", "first")
    start = F.when(F.col("trail") >= 4, F.col("trail_start")).when(F.col("first").isNotNull(), F.col("first")).when((F.col("n") >= 4) & (F.round("mean4", 9) < 0.35) & (F.col("trail") >= 3), F.col("trail_start"))
    return per.join(often, ["game_id", "sheet"], "left").select("game_id", "sheet", start.alias("start")).where("start is not null")


def tail_noise(tops: DataFrame) -> DataFrame:
    """(game_id, sheet, start): the earliest start that four detectors give: weak tail, repeated move, repeated pawn pushes, weak end.

    A ply is weak if it is less sure than moves of its kind are, or a simple
    move that the next one repeats. tops may have a column locked: such plies
    are never noise, and runs of repeats and pushes end at them.
    """
    locked = F.coalesce(F.col("locked"), F.lit(False)) if "locked" in tops.columns else F.lit(False)
    keys, level = ["game_id", "sheet"], complexity(F.col("move"))
    every = Window.partitionBy(*keys)
    beside = F.coalesce(F.lag("move").over(backward()), F.lead("move").over(backward()))  # the next move, or the one before the last
    t = tops.withColumns({"locked": locked, "conf": F.coalesce(F.nullif("conf", F.lit(0.0)), F.lit(0.9)), "level": level})
    t = t.withColumns({"back": F.row_number().over(backward()), "n": F.count("*").over(every), "rows": F.size(F.collect_set(F.floor(F.col("ply") / 2)).over(every)), "same": F.coalesce(F.col("move") == beside, F.lit(False))})
    t = t.withColumn("bad", ~F.col("locked") & ((F.col("conf") < F.when(F.col("level") < 2, 0.60).otherwise(0.30)) | (F.col("same") & (F.col("level") < 2))))
    good4 = (F.sum((~F.col("bad")).cast("int")).over(backward().rowsBetween(-3, 0)) == 4) & (F.col("back") >= 4)
    scanned = t.withColumn("ended", F.max(good4.cast("int")).over(backward())).where("ended = 0 and bad and n >= 4 and rows >= 3")
    a = scanned.groupBy(keys).agg(F.min("ply").alias("a"), F.count("*").alias("bads"), F.max("back").alias("length")).where("bads >= 3 and bads * 2 >= length").select(*keys, "a")
    last = F.first("move").over(backward())
    b = t.withColumn("differs", F.max(((F.col("move") != last) | F.col("locked")).cast("int")).over(backward())).where("differs = 0 and rows >= 2").groupBy(keys).agg(F.min("ply").alias("b"), F.count("*").alias("k")).where("k >= 3").drop("k")
    side = Window.partitionBy(*keys, "half").orderBy(F.desc("ply"))
    pushes = t.where("rows >= 4").withColumn("half", F.col("ply") % 2).withColumn("other", F.max((~F.col("move").rlike("^[a-h][1-8][+#]?$") | F.col("locked")).cast("int")).over(side)).where("other = 0")
    c = pushes.groupBy(*keys, "half").agg(F.count("*").alias("k"), F.count_distinct(F.regexp_replace("move", "[+#]$", "")).alias("d"), F.min("ply").alias("c")).where("k >= 3 and d < k").groupBy(keys).agg(F.min("c").alias("c"))
    sure = F.when(F.col("locked"), 1.0).otherwise(F.col("conf"))
    two = t.where("back <= 2 and n >= 4 and rows >= 3").groupBy(keys).agg(F.max(F.when(F.col("back") == 1, sure)).alias("l1"), F.max(F.when(F.col("back") == 2, sure)).alias("l2"), F.max("ply").alias("p1"), F.min("ply").alias("p2"))
    d = two.select(*keys, F.when((F.col("l1") < 0.55) & (F.col("l2") < 0.55), F.col("p2")).when(F.col("l1") < 0.50, F.col("p1")).alias("d"))
    starts = None
    for name, x in (("a", a), ("b", b), ("c", c), ("d", d)):
        x = x.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("start"))
        starts = x if starts is None else starts.unionByName(x)
    return starts.groupBy(keys).agg(F.min("start").alias("start"))


def trim_repeated_pairs(tops: DataFrame) -> DataFrame:
    """Rows without the last full moves that repeat the one before them; the first copy stays."""
    t = tops.withColumns({"n": F.count("*").over(Window.partitionBy("game_id", "sheet")), "i": F.row_number().over(by_sheet()) - 1, "before": F.lag("move", 2).over(by_sheet())})
    t = t.withColumn("pair", F.floor(F.col("i") / 2)).where("n % 2 = 0 or i < n - 1")
    pairs = t.groupBy("game_id", "sheet", "pair").agg(F.min((F.col("move") == F.col("before")).cast("int")).alias("same"))
    back = Window.partitionBy("game_id", "sheet").orderBy(F.desc("pair"))
    gone = pairs.withColumn("run", F.min(F.coalesce("same", F.lit(0))).over(back)).where("run = 1").select("game_id", "sheet", "pair")
    odd = tops.withColumns({"n": F.count("*").over(Window.partitionBy("game_id", "sheet")), "i": F.row_number().over(by_sheet()) - 1})
    return odd.withColumn("pair", F.floor(F.col("i") / 2)).join(gone, ["game_id", "sheet", "pair"], "left_anti").select("game_id", "sheet", "ply", "move")


def clusters_1d(values: DataFrame, keys: tuple[str, ...], value: str, tolerance: float, least: int = 4, middle: str = "median") -> DataFrame:
    """(keys, cluster, n, centre): sorted numbers (nulls left out) split where the gap exceeds the tolerance; clusters of `least` or more with their median or mean. Neither a key nor a cluster need fit a task (operators.order.clusters); the median is read off by place."""
    found = clusters(values.select(*keys, value), list(keys), value, tolerance)
    if middle == "mean":
        return found.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("centre")).where(F.col("n") >= least)
    sizes = found.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min("place").alias("_first")).where(F.col("n") >= least)
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "cluster"))), "n", "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "cluster"))]
    at = F.col("place") - F.col("_first")
    inner = found.join(sizes, same).where((at == F.floor((F.col("n") - 1) / 2)) | (at == F.floor(F.col("n") / 2)))
    return inner.groupBy(*keys, "cluster", "n").agg(F.avg(value).alias("centre"))


def repeated_pawn_targets(tops: DataFrame) -> DataFrame:
    """(game_id, sheet, ply, anchor_ply, suspect_ply): pawn moves of one colour and file that go where an earlier one of that file went, unless a pawn of that colour has captured onto the file before. The first such move is the anchor; the one of lower confidence is suspect, the later if they are equal. tops(game_id, sheet, ply, move, conf)."""
    bare = F.regexp_replace("move", "[+#x=]", "")
    bare = F.when((F.length(bare) >= 3) & F.substring(bare, -1, 1).isin(*"QRBN"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    t = tops.withColumns({"half": F.col("ply") % 2, "source": F.substring("move", 1, 1), "target": F.regexp_extract(bare, "([a-h][1-8])$", 1)}).where("source rlike '^[a-h]$' and target <> ''")
    onto = F.substring("target", 1, 1)
    key = ["game_id", "sheet", "half"]
    entered = t.where(F.col("move").contains("x") & (onto != F.col("source"))).groupBy(*key, onto.alias("source")).agg(F.min("ply").alias("entered"))
    w = Window.partitionBy(*key, "source", "target").orderBy("ply")
    first = t.withColumns({"anchor_ply": F.first("ply").over(w), "anchor_conf": F.first("conf").over(w)}).where("ply > anchor_ply")
    found = first.join(entered, [*key, "source"], "left").where("entered is null or entered >= ply")
    return found.select("game_id", "sheet", "ply", "anchor_ply", F.when(F.col("anchor_conf") < F.col("conf"), F.col("anchor_ply")).otherwise(F.col("ply")).alias("suspect_ply"))


def attention(rows: DataFrame, seconds: int = C.ATTENTION_SECONDS) -> DataFrame:
    """(open_game, seconds): gaps between an operator's interactions, up to the limit, booked to what was open when they started."""
    w = Window.partitionBy("operator_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return rows.withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= seconds)).groupBy("open_game").agg(F.sum("gap").alias("seconds"))


def length_progress(tops: DataFrame, games: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(game_id, plies, moves, progress): plies of the longer sheet, or half the known cells where no sheet is there; progress is confirmed/all moves, all/all of a verified game. games(game_id, cells, verified), confirmed(game_id, confirmed)."""
    longest = tops.groupBy("game_id", "sheet").agg(F.count("*").alias("n")).groupBy("game_id").agg(F.max("n").alias("n"))
    plies = F.coalesce("n", F.ceil(F.col("cells") / 2).cast("long"))
    t = games.join(longest, "game_id", "left").join(confirmed, "game_id", "left").withColumn("plies", plies)
    half = lambda c: F.ceil(F.col(c) / 2).cast("long")
    done = F.when(F.col("verified"), half("plies")).when(F.col("confirmed") > 0, half("confirmed"))
    return t.select("game_id", "plies", half("plies").alias("moves"), F.concat_ws("/", done.cast("string"), half("plies").cast("string")).alias("progress"))
