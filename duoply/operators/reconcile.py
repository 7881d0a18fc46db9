"""Two readings of a sequence, merged: joins, pools and reliability.

Input everywhere: candidates(game_id, sheet, ply, rk, move, conf), rank 0 the
reading, higher ranks its alternatives. Everything is keyed by game_id and ply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply import config as C
from duoply.functions.moves import normalize_move, parse_move

CELL = ["game_id", "ply"]


def confidence(conf: Column, default: float = C.DEFAULT_ALTERNATIVE) -> Column:
    """Missing and zero confidences count as the default."""
    return F.coalesce(F.nullif(conf, F.lit(0.0)), F.lit(default))


def normed(c: DataFrame) -> DataFrame:
    return c.withColumn("norm", normalize_move(F.col("move")))


def tops(c: DataFrame) -> DataFrame:
    """(game_id, ply, m1, c1, m2, c2): both sheets' readings, full outer."""
    a, b = (c.where((F.col("rk") == 0) & (F.col("sheet") == s)).select(*CELL, F.col("move").alias(f"m{s}"), F.col("conf").alias(f"c{s}")) for s in (1, 2))
    return a.join(b, CELL, "full_outer")


def pool(alternatives: DataFrame) -> DataFrame:
    """(game_id, ply, norm, conf, sources, place): sums of rows (sheet, seen, norm, conf) by normalised move, capped; ten each, first seen first among equals."""
    sums = alternatives.groupBy(*CELL, "norm").agg(F.least(F.sum("conf"), F.lit(C.SUPPORT_CAP)).alias("conf"), F.array_join(F.array_sort(F.collect_set(F.col("sheet").cast("string"))), ",").alias("sources"), F.min("seen").alias("seen"))
    order = Window.partitionBy(CELL).orderBy(F.desc(F.round("conf", 9)), "seen")
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= C.POOL_SIZE).drop("seen")


def alternatives(c: DataFrame) -> DataFrame:
    return normed(c.where("rk > 0")).select(*CELL, "norm", confidence(F.col("conf")).alias("conf"), "sheet", (F.col("sheet") * 1000 + F.col("rk")).alias("seen"))


def support(c: DataFrame) -> DataFrame:
    """(game_id, ply, sheet, norm, conf): the confidence a cell gives a move, its reading first, then its first equal alternative."""
    return normed(c).groupBy(*CELL, "sheet", "norm").agg(F.min_by("conf", "rk").alias("conf"))


def summed_support(c: DataFrame) -> DataFrame:
    return support(c).groupBy(*CELL, "norm").agg(F.least(F.sum("conf"), F.lit(C.SUPPORT_CAP)).alias("support"), F.min(F.coalesce("conf", F.lit(0.0))).alias("least"), F.count("*").alias("sheets"))


def reliability(c: DataFrame) -> DataFrame:
    """(game_id, n, rate, unreliable): share of plies with both readings that agree."""
    t = tops(c).where("m1 is not null and m2 is not null")
    agree = (normalize_move(F.col("m1")) == normalize_move(F.col("m2"))).cast("int")
    rates = t.groupBy("game_id").agg(F.count("*").alias("n"), F.avg(agree).alias("rate"))
    return c.select("game_id").distinct().join(rates, "game_id", "left").select("game_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(1.0)).alias("rate")).withColumn("unreliable", (F.col("n") >= C.RELIABLE_PLIES) & (F.col("rate") < C.RELIABLE_RATE))


def cells(c: DataFrame) -> DataFrame:
    """(game_id, ply, r1, r2): each cell's readings of both sheets as arrays of (rk, move, norm, conf) by rank: what is compared within a cell needs no join."""
    row = lambda s: F.array_sort(F.collect_list(F.when(F.col("sheet") == s, F.struct("rk", "move", "norm", "conf")))).alias(f"r{s}")
    return normed(c).groupBy(*CELL).agg(row(1), row(2))


def given(rows: str, norm: Column) -> Column:
    """Confidence of the first reading of an array that is this move, or null."""
    return F.get(F.filter(rows, lambda r: r["norm"] == norm), F.lit(0))["conf"]


def merge(c: DataFrame) -> DataFrame:
    """One row a ply: the merged move, its confidence, and flags agree, ambiguous, consensus, promoted, sheet_count.

    Stages: pick by agreement or by summed support; promote the pool's best if
    it has more than the pick's support; stop on near ties of strong readings,
    and whenever two credible queen moves differ in their square. Rows are
    shuffled once, by game.
    """
    top = lambda i: F.get(F.filter(f"r{i}", lambda r: r["rk"] == 0), F.lit(0))
    t = cells(c.repartition("game_id")).withColumns({f"t{i}": top(i) for i in (1, 2)}).where("t1 is not null or t2 is not null")
    t = t.withColumns({f"{k}{i}": F.col(f"t{i}")[f] for i in (1, 2) for k, f in (("m", "move"), ("n", "norm"), ("c", "conf"))})

    def support(norm: Column) -> dict[str, Column]:
        has = [F.exists(f"r{i}", lambda r: r["norm"] == norm) for i in (1, 2)]
        conf = [F.coalesce(given(f"r{i}", norm), F.lit(0.0)) for i in (1, 2)]
        return {"sum": F.when(has[0] | has[1], F.least(conf[0] + conf[1], F.lit(C.SUPPORT_CAP))), "least": F.least(*(F.when(h, x) for h, x in zip(has, conf))), "sheets": has[0].cast("int") + has[1].cast("int")}

    t = t.withColumns({"sheet_count": F.col("m1").isNotNull().cast("int") + F.col("m2").isNotNull().cast("int"), "s1": support(F.col("n1"))["sum"], "s2": support(F.col("n2"))["sum"]})
    both = F.col("sheet_count") == 2
    t = t.withColumn("agree", both & (F.col("n1") == F.col("n2")))
    game = Window.partitionBy("game_id")
    rate = F.avg(F.when(both, F.col("agree").cast("int"))).over(game)
    t = t.withColumn("unreliable", F.coalesce((F.count_if(both).over(game) >= C.RELIABLE_PLIES) & (rate < C.RELIABLE_RATE), F.lit(False)))
    first = F.col("m2").isNull() | (F.col("m1").isNotNull() & (F.round("s1", 9) >= F.round("s2", 9)))
    strong = F.col("c1") >= F.col("c2")
    entry = lambda norm, conf, seen: F.struct(norm.alias("norm"), confidence(conf).alias("conf"), seen.cast("long").alias("seen"))
    others = [F.transform(F.filter(f"r{i}", lambda r: r["rk"] > 0), lambda r, i=i: entry(r["norm"], r["conf"], r["rk"] + 1000 * i)) for i in (1, 2)]
    loser = entry(F.when(strong, F.col("n2")).otherwise(F.col("n1")), F.when(strong, F.col("c2")).otherwise(F.col("c1")), F.when(strong, 1999).otherwise(2999))
    t = t.withColumn("pool", F.concat(*others, F.filter(F.array(F.when(both & ~F.col("agree"), loser)), lambda x: x.isNotNull())))

    def scored(norm: Column) -> Column:
        own = F.filter("pool", lambda x: x["norm"] == norm)
        conf = F.least(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x["conf"]), F.lit(C.SUPPORT_CAP))
        return F.struct((-F.round(conf, 9)).alias("a"), F.array_min(F.transform(own, lambda x: x["seen"])).alias("b"), norm.alias("norm"), conf.alias("conf"))

    t = t.withColumns({
        "best": F.array_min(F.transform(F.array_distinct(F.transform("pool", lambda x: x["norm"])), scored)),
        "pick": F.when(F.col("agree"), F.col("n1")).when(first, F.col("m1")).otherwise(F.col("m2")),
        "conf": F.when(F.col("agree"), F.least(F.col("c1") + F.col("c2") * 0.5, F.lit(C.SUPPORT_CAP))).when(~both, F.coalesce("c1", "c2")).when(first, F.col("s1")).otherwise(F.col("s2")),
        "pick_support": F.when(first | F.col("agree"), F.col("s1")).otherwise(F.col("s2")),
    })
    t = t.withColumn("promoted", F.coalesce(both & (F.round("best.conf", 9) > F.round("pick_support", 9)), F.lit(False)))
    t = t.withColumns({"move": F.when(F.col("promoted"), F.col("best.norm")).otherwise(F.col("pick")), "conf": F.when(F.col("promoted"), F.col("best.conf")).otherwise(F.col("conf"))})
    # the target of a queen's move, as parse_move() gives it, by one pattern
    a, b = (F.regexp_extract(f"n{i}", r"^Q[a-h]?[1-8]?x?([a-h][1-8])(?:=?[QRBN])?$", 1) for i in (1, 2))
    clash = F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    tie = (F.round(F.abs(F.col("s1") - F.col("s2")), 9) < C.NEAR_TIE) & (F.greatest("c1", "c2") >= C.NEAR_TIE_CONF) & (~F.col("unreliable") | clash)
    t = t.withColumn("final", normalize_move(F.col("move")))
    stop = both & ~F.col("agree") & F.col("final").isin(F.col("n1"), F.col("n2")) & (tie | (clash & (F.least("s1", "s2") >= C.CLASH_CONF)))
    seen = support(F.col("final"))
    consensus = F.col("agree") | ((seen["sheets"] == 2) & (seen["least"] >= C.CONSENSUS_EACH) & (F.round(seen["sum"], 9) >= C.CONSENSUS_SUM))
    return t.select(*CELL, "move", "conf", "sheet_count", "agree", "promoted", F.coalesce(stop, F.lit(False)).alias("ambiguous"), F.coalesce(both & consensus, F.lit(False)).alias("consensus"))


def overlap(c: DataFrame, with_top: bool = True) -> DataFrame:
    """(game_id, ply, overlap): sum over shared moves of both confidences, which are added to each other first; of repeats the left side's last counts, the right side's all."""
    t = cells(c if with_top else c.where("rk > 0"))
    last = lambda norm: F.element_at(F.filter("r1", lambda r: r["norm"] == norm), -1)["conf"]
    t = t.withColumn("shared", F.filter("r2", lambda r: F.exists("r1", lambda x: x["norm"] == r["norm"]))).where(F.size("shared") > 0)
    return t.select(*CELL, F.aggregate("shared", F.lit(0.0), lambda acc, r: acc + (last(r["norm"]) + r["conf"])).alias("overlap"))


def structured_overlap(c: DataFrame) -> DataFrame:
    """(game_id, ply, score): shared target, rank, file and piece mass, each capped, and shared moves, blended."""
    p = normed(c).withColumn("p", parse_move(F.col("move")))
    row = lambda s: F.collect_list(F.when(F.col("sheet") == s, F.struct(F.col("p.target").alias("target"), F.col("p.rank").alias("rank"), F.col("p.file").alias("file"), F.col("p.piece").alias("piece"), F.col("norm").alias("move"), "conf"))).alias(f"r{s}")
    t = p.groupBy(*CELL).agg(row(1), row(2))
    kinds = ("target", "rank", "file", "piece", "move")
    values = lambda s, k: F.array_compact(F.transform(f"r{s}", lambda r: r[k]))
    t = t.withColumns({f"v_{k}": F.array_intersect(values(1, k), values(2, k)) for k in kinds}).where(F.greatest(*(F.size(f"v_{k}") for k in kinds)) > 0)

    def mass(k: str) -> Column:
        of = lambda s: F.aggregate(F.filter(f"r{s}", lambda r: F.array_contains(F.col(f"v_{k}"), r[k])), F.lit(0.0), lambda acc, r: acc + r["conf"])
        return F.least(of(1) + of(2), F.lit(C.STRUCTURED_CAP))

    return t.select(*CELL, sum(mass(k) * w for k, w in zip(kinds, C.STRUCTURED_WEIGHTS)).alias("score"))


def detect_shift(c: DataFrame) -> DataFrame:
    """(game_id, shift, agreements, rate): the move offset under which the readings agree best, if it is enough better than none."""
    t = normed(c.where("rk = 0 and move <> ''")).select("game_id", "sheet", F.floor(F.col("ply") / 2).alias("num"), (F.col("ply") % 2).alias("half"), "norm")
    a, b = (t.where(F.col("sheet") == s).drop("sheet") for s in (1, 2))
    sizes = t.groupBy("game_id").agg(F.count_if(F.col("sheet") == 1).alias("k1"), F.count_if(F.col("sheet") == 2).alias("k2"))
    tried = a.withColumn("shift", F.explode(F.sequence(F.lit(-C.SHIFT_RANGE), F.lit(C.SHIFT_RANGE)))).withColumn("num", F.col("num") + F.col("shift"))
    hits = tried.join(b, ["game_id", "num", "half", "norm"]).groupBy("game_id", "shift").agg(F.count("*").alias("agreements"))
    order = Window.partitionBy("game_id").orderBy(F.desc("agreements"), "shift")
    base = hits.where("shift = 0").select("game_id", F.col("agreements").alias("base"))
    best = hits.withColumn("r", F.row_number().over(order)).where("r = 1").join(sizes, "game_id").join(base, "game_id", "left")
    rate, base_rate = F.col("agreements") / F.col("k1"), F.coalesce("base", F.lit(0)) / F.col("k1")
    return best.where((F.col("k1") >= C.SHIFT_LEAST) & (F.col("k2") >= C.SHIFT_LEAST) & (F.col("shift") != 0) & (F.col("agreements") >= C.SHIFT_LEAST) & (rate > base_rate + C.SHIFT_GAIN)).select("game_id", "shift", "agreements", rate.alias("rate"))


def square(move: Column) -> Column:
    """The first square that a move names, or null."""
    return F.nullif(F.regexp_extract(move, "[a-h][1-8]", 0), F.lit(""))


def piece(move: Column) -> Column:
    return F.when(F.substring(move, 1, 1).isin(*"KQRBN"), F.substring(move, 1, 1)).otherwise("P")


def shade(move: Column) -> Column:
    """light or dark: of the square a bishop goes to; null for other pieces."""
    at = F.substring(F.regexp_replace(move, "[+#]+$", ""), -2, 2)
    odd = (F.ascii(at) - F.ascii(F.lit("a")) + F.substring(at, 2, 1).try_cast("int") - 1) % 2 == 1
    return F.when((F.substring(move, 1, 1) == "B") & at.rlike("^[a-h][1-8]$"), F.when(odd, "light").otherwise("dark"))


def reachable(kind: Column, a: Column, b: Column) -> Column:
    """Whether a queen, rook or bishop may go from square a to square b on an empty board."""
    file, rank = F.abs(F.ascii(a) - F.ascii(b)), F.abs(F.substring(a, 2, 1).cast("int") - F.substring(b, 2, 1).cast("int"))
    slant, straight = (file == rank) & (file > 0), (file == 0) != (rank == 0)
    return F.when(kind == "B", slant).when(kind == "R", straight).when(kind == "Q", slant | straight).otherwise(False)


def future_reference(c: DataFrame) -> DataFrame:
    """(game_id, ply, later_ply, event, bonus) for each top reading of c (one sheet) on a square: what first happens to it later.

    The piece may leave (a reading of the same piece and colour elsewhere: +4 if
    it can go there); or the square is named, by a top reading or an alternative
    that counts as seen: an opponent's capture gives +8, the same piece coming
    again without a capture -4, anything else 0. Both are the next row of an
    equality window, so nothing is joined by range.
    """
    t = c.withColumns({"x": square(F.col("move")), "kind": piece(F.col("move")), "half": F.col("ply") % 2}).where("x is not null")
    tops = t.where("rk = 0").select("game_id", "ply", "x", "kind", "half", F.col("move").alias("top"))
    mine = Window.partitionBy("game_id", "half", "kind").orderBy("ply")
    tops = tops.withColumns({"go_ply": F.lead("ply").over(mine), "go_x": F.lead("x").over(mine)})
    named = t.where((F.col("rk") == 0) | (F.col("conf") >= C.SEEN_CONF)).groupBy("game_id", "ply", "x").agg(F.min_by("move", "rk").alias("text"), F.min("rk").alias("rk"))
    there = Window.partitionBy("game_id", "x").orderBy("ply")
    named = named.withColumns({"ref_ply": F.lead("ply").over(there), "text": F.lead("text").over(there)}).where("rk = 0").select("game_id", "ply", "x", "ref_ply", "text")
    j = tops.join(named, ["game_id", "ply", "x"])
    leaves = F.col("go_ply").isNotNull() & (F.col("go_x") != F.col("x")) & (F.col("go_ply") <= F.coalesce("ref_ply", F.col("go_ply")))
    own, takes = F.col("ref_ply") % 2 == F.col("half"), F.col("text").contains("x")
    again = own & ~takes & (piece(F.col("text")) == F.col("kind"))
    event = F.when(leaves, "leaves").when(~own & takes, "captured").when(again, "returns").when(F.col("ref_ply").isNotNull(), "other")
    bonus = F.when(leaves, F.when(reachable(F.col("kind"), F.col("x"), F.col("go_x")), 4).otherwise(0)).when(~own & takes, 8).when(again, -4).otherwise(0)
    return j.select("game_id", "ply", F.when(leaves, F.col("go_ply")).otherwise(F.col("ref_ply")).alias("later_ply"), event.alias("event"), bonus.alias("bonus")).where("event is not null")


def future_piece_moves(c: DataFrame) -> DataFrame:
    """(game_id, ply, later, next_ply, surest): of each reading, how many later ones of its game, side and piece are sure, the ply of the first, and the plies of those that are surest, in order. Bishops are told apart by the shade of the square they go to. c(game_id, ply, move, conf) has one reading a ply; a move that is null is a pawn's."""
    m = F.coalesce("move", F.lit(""))
    own = c.select("game_id", "ply", "conf", (F.col("ply") % 2).alias("half"), piece(m).alias("kind"), F.coalesce(shade(m), F.lit("")).alias("shade"))
    after = Window.partitionBy("game_id", "half", "kind", "shade").orderBy("ply").rowsBetween(1, Window.unboundedFollowing)
    sure = F.col("conf") >= C.SURE_CONF
    plies = F.array_sort(F.collect_list(F.when(F.col("conf") >= C.SUREST_CONF, F.col("ply"))).over(after))
    return own.select("game_id", "ply", F.coalesce(F.sum(sure.cast("long")).over(after), F.lit(0)).alias("later"), F.min(F.when(sure, F.col("ply"))).over(after).alias("next_ply"), plies.alias("surest"))


def paired_moves(cells: DataFrame) -> DataFrame:
    """(game_id, sheet, num, white, black, white_conf, black_conf) from cells(game_id, sheet, pos, num, color, move, conf) in the order of pos; a missing conf is DEFAULT_TOP.

    Where a number and colour come twice on a sheet, numbers are ignored: a white
    cell opens a row, a black one right behind it fills it, any other black cell
    is a row of its own.
    """
    by = Window.partitionBy("game_id", "sheet")
    conf = F.coalesce("conf", F.lit(C.DEFAULT_TOP))
    seen = cells.withColumn("_n", F.count("*").over(Window.partitionBy("game_id", "sheet", "num", "color"))).withColumn("_twice", F.max("_n").over(by) > 1)
    order = by.orderBy("pos")
    opens = (F.col("color") == "w") | ~F.lag("color").over(order).eqNullSafe("w")
    row = seen.withColumn("_opens", opens.cast("int")).withColumn("_row", F.sum("_opens").over(order))
    num = F.when(F.col("_twice"), F.col("_row")).otherwise(F.col("num"))
    side = lambda c, v: F.max_by(v, F.when(F.col("color") == c, F.col("pos")))
    grouped = row.withColumn("conf", conf).groupBy("game_id", "sheet", num.alias("num"))
    return grouped.agg(*(F.coalesce(side(c, "move"), F.lit("")).alias(name) for name, c in (("white", "w"), ("black", "b"))), *(F.coalesce(side(c, "conf"), F.lit(C.DEFAULT_TOP)).alias(f"{name}_conf") for name, c in (("white", "w"), ("black", "b"))))


def flat_moves(rows: DataFrame) -> DataFrame:
    """(game_id, sheet, i, move, conf): the inverse of paired_moves(), without blanks."""
    sides = F.array(F.struct(F.lit(0).alias("half"), F.col("white").alias("move"), F.col("white_conf").alias("conf")), F.struct(F.lit(1).alias("half"), F.col("black").alias("move"), F.col("black_conf").alias("conf")))
    flat = rows.select("game_id", "sheet", "num", F.explode(sides).alias("s")).select("game_id", "sheet", "num", "s.*").where("move <> ''")
    return flat.select("game_id", "sheet", (F.row_number().over(Window.partitionBy("game_id", "sheet").orderBy("num", "half")) - 1).cast("long").alias("i"), "move", "conf")


def candidate_profile(c: DataFrame) -> DataFrame:
    """(game_id, ply, pieces, destinations, top_pieces, captures, capture_ratio, piece_ratio): what the readings of a cell have in common; counts as `x:n`, most frequent first, then as first seen."""
    t = c.withColumns({"p": F.nullif(F.regexp_extract("move", "^[KQRBN]", 0), F.lit("")), "x": square(F.col("move"))})

    def counted(name: str, out: str, most: int | None = None) -> DataFrame:
        n = t.where(F.col(name).isNotNull()).groupBy("game_id", "ply", name).agg(F.count("*").alias("n"), F.min("rk").alias("rk"))
        rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "rk", F.concat_ws(":", F.col(name), F.col("n").cast("string")).alias("text"))))
        rows = rows if most is None else F.slice(rows, 1, most)
        return n.groupBy("game_id", "ply").agg(F.concat_ws(",", F.transform(rows, lambda r: r["text"])).alias(out))

    taking = F.count_if(F.col("move").contains("x"))
    base = t.groupBy("game_id", "ply").agg(taking.alias("captures"), (taking / F.count("*")).alias("capture_ratio"), (F.count("p") / F.count("*")).alias("piece_ratio"))
    for part in (counted("p", "pieces"), counted("x", "destinations"), counted("p", "top_pieces", 2)):
        base = base.join(part, ["game_id", "ply"], "left")
    return base.fillna("", ["pieces", "destinations", "top_pieces"])
