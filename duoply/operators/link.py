"""Record linkage: files to games, games to pairings, pairings to players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply.functions.records import pair_key, person_key, scan_name, scan_path
from duoply.operators.order import ordinals

SEAT = ["section", "round"]


def dedupe_files(files: DataFrame) -> DataFrame:
    """The first row of each lower-cased path, then of each (name, size, time); order is file_id."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    first = lambda df, keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("file_id"))).where("_r = 1").drop("_r")
    return first(first(files, [F.lower("path")]), [name, F.col("size_bytes"), F.col("modified_at")])


def placed_files(files: DataFrame, default: str = "Main") -> DataFrame:
    """files with section (folder first), round, board and page (file name first)."""
    p = files.withColumns({"_n": scan_name(F.element_at(F.split("path", "/"), -1)), "_p": scan_path(F.col("path"))})
    return p.select(*files.columns, F.coalesce("_p.section", "_n.section", F.lit(default)).alias("section"), F.coalesce("_n.round", "_p.round").alias("round"), F.coalesce("_n.board", "_p.board").alias("board"), F.coalesce("_n.page", "_p.page").alias("page"))


def group_files(files: DataFrame) -> DataFrame:
    """(game_id, section, round, board, pages): files of each game, by page and then name; files without round or board are left out."""
    placed = placed_files(files).where("round is not null and board is not null")
    name = F.element_at(F.split("path", "/"), -1)
    row = F.struct(F.coalesce("page", F.lit(1 << 40)).alias("page"), name.alias("name"), F.col("file_id"))
    game = F.concat(F.col("section"), F.lit("_R"), F.col("round").cast("string"), F.lit("_B"), F.col("board").cast("string"))
    grouped = placed.groupBy(game.alias("game_id"), "section", "round", "board").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("game_id", "section", "round", "board", F.transform("rows", lambda r: r["file_id"]).alias("pages"))


def section_choices(games: DataFrame, pairings: DataFrame) -> DataFrame:
    """(wanted, round, section): the sections of pairings that a lower-cased section of games may mean in a round: those whose name contains it, or all of the round where none does. Distinct names only, so the comparison is small."""
    wanted = games.select(F.lower(F.coalesce("section", F.lit(""))).alias("wanted"), "round").distinct()
    both = wanted.join(pairings.select(*SEAT).distinct(), "round")
    hit = (F.col("wanted") != "") & F.lower("section").contains(F.col("wanted"))
    some = F.bool_or(hit).over(Window.partitionBy("round", "wanted"))
    return both.withColumns({"_hit": hit, "_some": some}).where("_hit or not _some").select("wanted", *SEAT)


def match_games(games: DataFrame, pairings: DataFrame) -> DataFrame:
    """(game_id, pairing_id, how): board equality in the round and section (see section_choices), else the section-relative board, where a section's boards begin above 1 and the game's is within its number of pairings. games(game_id, section, round, board)."""
    known = pairings.groupBy(*SEAT).agg(F.min("board").alias("low"), F.count("*").alias("n"))  # one row a seat list, so that no list meets in one task
    seats = pairings.where("board is not null").join(known, SEAT).select(*SEAT, "board", "low", "n", "pairing_id")
    g = games.where("round is not null and board is not null").select("game_id", "round", "board", F.lower(F.coalesce("section", F.lit(""))).alias("wanted")).join(section_choices(games, pairings), ["wanted", "round"])
    exact = g.join(seats, [*SEAT, "board"]).select("game_id", "pairing_id", F.lit("board").alias("how"), F.lit(0).alias("_p"), "section")
    s = seats.where("low > 1").select(*SEAT, (F.col("board") - F.col("low") + 1).alias("board"), "n", "pairing_id")
    moved = g.join(s, [*SEAT, "board"]).where(F.col("board").between(1, F.col("n"))).select("game_id", "pairing_id", F.lit("offset").alias("how"), F.lit(1).alias("_p"), "section")
    best = Window.partitionBy("game_id").orderBy("_p", "section", "pairing_id")
    return exact.union(moved).withColumn("_k", F.row_number().over(best)).where("_k = 1").select("game_id", "pairing_id", "how")


def attach_by_order(games: DataFrame, pairings: DataFrame, matched: DataFrame) -> DataFrame:
    """(game_id, pairing_id): what is left on both sides of a round and section, zipped by board where the counts are equal. A pairing that two sections of games may mean is offered to both."""
    seat = ["wanted", "round"]
    left = games.where("round is not null and board is not null").withColumn("wanted", F.lower(F.coalesce("section", F.lit("")))).join(matched, "game_id", "left_anti")
    right = pairings.join(matched, "pairing_id", "left_anti").join(section_choices(games, pairings), SEAT)
    a = ordinals(left.select(*seat, "board", "game_id"), seat, ["board", "game_id"], "k")
    b = ordinals(right.select(*seat, "board", "pairing_id"), seat, [F.asc_nulls_last("board"), "pairing_id"], "k")
    size = lambda side, n: side.groupBy(*seat).agg(F.count("*").alias(n))
    even = size(a, "n").join(size(b, "m"), seat).where("n = m").select(*seat)
    return a.join(even, seat).join(b.drop("board"), [*seat, "k"]).select("game_id", "pairing_id")


def attach(games: DataFrame, pairings: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(game_id, pairing_id, via_order, board, scan_board): matches, then what could be zipped, flagged. A game takes its pairing's board and keeps its own as scan_board, unless from_directory says that its own came from a folder."""
    first = match_games(games, pairings).select("game_id", "pairing_id") if matched is None else matched
    both = first.withColumn("via_order", F.lit(False)).union(attach_by_order(games, pairings, first).withColumn("via_order", F.lit(True)))
    g, p = games.select("game_id", F.col("board").alias("own"), "from_directory"), pairings.select("pairing_id", F.col("board").alias("given"))
    taken = F.col("given").isNotNull() & (F.col("given") != F.col("own")) & ~F.col("from_directory")
    return both.join(g, "game_id").join(p, "pairing_id").select("game_id", "pairing_id", "via_order", F.when(taken, F.col("given")).otherwise(F.col("own")).alias("board"), F.when(taken, F.col("own")).alias("scan_board"))


def donate_boards(base: DataFrame, donors: DataFrame) -> DataFrame:
    """base with missing boards taken from donors with the same round and players, never overwritten."""
    key = pair_key(F.col("white_name"), F.col("black_name"))
    given = donors.where("board is not null").groupBy("round", key.alias("_key")).agg(F.min("board").alias("_board"))
    return base.withColumn("_key", key).join(given, ["round", "_key"], "left").withColumn("board", F.coalesce("board", "_board")).drop("_key", "_board")


def known(value: Column, kind: str) -> Column:
    """value, or null where it is 0 or blank."""
    return F.when(F.trim(value) != "", value) if kind == "string" else F.nullif(value, F.lit(0).cast(kind))


#: Fields of a player that pairings carry for either side.
PLAYER = ("rtg", "title", "fed", "fide_id")


def backfill_players(pairings: DataFrame, roster: DataFrame) -> DataFrame:
    """Missing ratings, titles, federations and ids of both sides from roster(section, number, name and PLAYER): by section and start number, else by name. Only blanks (null, 0, empty) are filled."""
    kinds = dict(roster.dtypes)
    best = lambda keys, mark: roster.groupBy(*keys).agg(*(F.max(known(F.col(f), kinds[f])).alias(f"{mark}_{f}") for f in PLAYER))
    numbers, names = best(["section", "number"], "_n"), best([person_key(F.col("name")).alias("_key")], "_m")
    for side in ("white", "black"):
        pairings = pairings.withColumn("_key", person_key(F.col(f"{side}_name"))).join(numbers.withColumnRenamed("number", f"{side}_sno"), ["section", f"{side}_sno"], "left").join(names, "_key", "left")
        own = dict(pairings.dtypes)
        pairings = pairings.withColumns({f"{side}_{f}": F.coalesce(known(F.col(f"{side}_{f}"), own[f"{side}_{f}"]), F.col(f"_n_{f}"), F.col(f"_m_{f}")) for f in PLAYER})
        pairings = pairings.drop("_key", *(f"{m}_{f}" for m in ("_n", "_m") for f in PLAYER))
    return pairings


def merge_headers(parts: DataFrame) -> DataFrame:
    """(key, value) of headers from parts(source, key, value): the first value by source that is neither blank nor a placeholder, else the last placeholder."""
    there = F.trim("value") != ""
    real = there & ~F.col("value").isin("?", "-")
    return parts.where(there).groupBy("key").agg(F.coalesce(F.min_by("value", F.when(real, F.col("source"))), F.max_by("value", "source")).alias("value"))


def merge_players(parts: DataFrame) -> DataFrame:
    """A row for each (section, number) of players from several sources: every field from the first source that has it. parts(source, section, number, name and PLAYER)."""
    kinds = dict(parts.dtypes)
    first = lambda f: F.min_by(f, F.when(known(F.col(f), kinds[f]).isNotNull(), F.col("source"))).alias(f)
    return parts.groupBy("section", "number").agg(first("name"), *map(first, PLAYER))


#: Fields of pairings that sources complete for each other.
MERGED = ("white_name", "black_name", "white_rtg", "black_rtg", "result", "played_at")


def merge_sources(parts: DataFrame) -> DataFrame:
    """Pairings from several sources, one row a pair of numbers in a section and round: the first one with a board is the base, and what it lacks (null, 0, blank, `*`) comes from the first other source that has it. Rows without numbers are kept apart. Columns: SEAT, low_no, high_no, board, those of MERGED that there are, sources."""
    low, high = F.least("white_sno", "black_sno"), F.greatest("white_sno", "black_sno")
    both = F.col("white_sno").isNotNull() & F.col("black_sno").isNotNull()
    keyed = parts.withColumns({"low_no": low, "high_no": high, "alone": F.when(~both, F.col("pairing_id")), "_o": F.struct("source", "pairing_id")})
    key = [*SEAT, "low_no", "high_no", "alone"]
    base = F.min(F.when(F.col("board").isNotNull(), F.col("_o"))).over(Window.partitionBy(*key))
    keyed = keyed.withColumn("_order", F.struct((~F.col("_o").eqNullSafe(base)).alias("a"), F.col("_o").alias("b")))
    kinds = dict(parts.dtypes)

    def has(f: str) -> Column:
        value = F.col(f)
        return value.isNotNull() if kinds[f] not in ("string", "bigint", "int") else known(value, kinds[f]).isNotNull() & (F.lit(True) if kinds[f] != "string" else value != "*")

    first = lambda f: F.coalesce(F.min_by(f, F.when(has(f), F.col("_order"))), F.min_by(f, "_order")).alias(f)
    return keyed.groupBy(*key).agg(F.min_by("board", F.when(F.col("board").isNotNull(), F.col("_order"))).alias("board"), *(first(f) for f in MERGED if f in kinds), F.count("*").alias("sources")).drop("alone")


def newest(records: DataFrame) -> DataFrame:
    """The newest finished record of each game; of equal times the per-game one. records(game_id, source, modified, text, finished)."""
    order = Window.partitionBy("game_id").orderBy(F.desc("modified"), "source")
    return records.where("finished and text <> ''").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def event_types(pairings: DataFrame) -> DataFrame:
    """(section, players, rounds, event_type): round robin if no pair meets twice and rounds fit the players."""
    both = (F.coalesce("white_sno", F.lit(0)) != 0) & (F.coalesce("black_sno", F.lit(0)) != 0)
    p = pairings.where(both)
    pairs = p.groupBy("section", F.least("white_sno", "black_sno").alias("a"), F.greatest("white_sno", "black_sno").alias("b")).count().groupBy("section").agg(F.max("count").alias("most"))
    players = p.select("section", F.explode(F.array("white_sno", "black_sno")).alias("player")).groupBy("section").agg(F.count_distinct("player").alias("players"))
    rounds = pairings.groupBy("section").agg(F.count_distinct("round").alias("rounds"))
    fits = (F.col("most") == 1) & F.col("rounds").isin(F.col("players"), F.col("players") - 1)
    return rounds.join(players, "section", "left").join(pairs, "section", "left").select("section", "players", "rounds", F.when(fits, "round robin").otherwise("swiss").alias("event_type"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts of an event, whose keys are disjoint; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_headers(heads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, event, site, starts, ends, sections) of the parts' heads (keys, order, section, event, site, starts, ends): the first event and site that aren't empty, in the given order, the earliest start, the latest end, and all sections by name. Dates are texts that sort."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.struct(*order))), F.lit("")).alias(c)
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return heads.groupBy(*keys).agg(first("event"), first("site"), F.min(some("starts")).alias("starts"), F.max(some("ends")).alias("ends"), F.array_sort(F.collect_set(some("section"))).alias("sections"))


#: Where nothing is known (fixed values).
NO_DATE, NO_EVENT = "????.??.??", "Tournament"
#: Optional tags of a pairing, and the columns they come from.
PAIRING_TAGS = {
    "WhiteElo": "white_rtg", "BlackElo": "black_rtg", "WhiteTitle": "white_title", "BlackTitle": "black_title", "WhiteNationalId": "white_id", "BlackNationalId": "black_id",
    "WhiteFideId": "white_fide_id", "BlackFideId": "black_fide_id",
}


def build_headers(games: DataFrame, pairings: DataFrame, tournaments: DataFrame, profiles: DataFrame, overrides: DataFrame, date: str = NO_DATE) -> DataFrame:
    """(game_id, headers map) of each game: seven tags, and optional ones where they are known.

    An override wins over the pairing, that over the tournament, that over the
    place of the sheet's profile, and that over a default. games(game_id,
    section, round, board, pairing_id, profile); pairings(pairing_id,
    white_name, black_name, result, date, and columns of PAIRING_TAGS as far as
    there are); tournaments(section, event, site, start_date, country,
    event_type, rounds); profiles(profile, site, country); overrides(game_id,
    headers map). Empty texts and zeros count as unknown; the round is
    round.board, the round, ?.board, or ?.
    """
    known = lambda c: F.nullif(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("0"))
    p = pairings.select("pairing_id", *(known(c).alias(f"_p_{c}") for c in ("white_name", "black_name", "result", "date")), *(known(c).alias(f"_p_{c}") for c in PAIRING_TAGS.values() if c in pairings.columns))
    t = tournaments.select("section", *(known(c).alias(f"_t_{c}") for c in ("event", "site", "start_date", "country", "event_type", "rounds")), F.lit(True).alias("_t"))
    f = profiles.select("profile", *(known(c).alias(f"_f_{c}") for c in ("site", "country")))
    o = overrides.select("game_id", F.col("headers").alias("_o"))
    g = games.join(p, "pairing_id", "left").join(t, "section", "left").join(f, "profile", "left").join(o, "game_id", "left")
    of = lambda c: F.coalesce(*(F.col(x) for x in c.split() if x in g.columns), F.lit(None).cast("string"))
    round_, board = F.col("round").cast("string"), F.col("board").cast("string")
    place = F.coalesce(F.concat_ws(".", F.coalesce(round_, F.lit("?")), board), F.lit("?"))
    tags = {
        "Event": F.coalesce(of("_t_event"), F.lit(NO_EVENT)), "Site": F.coalesce(of("_t_site _f_site"), F.lit("?")), "Date": F.coalesce(of("_p_date _t_start_date"), F.lit(date)), "Round": place,
        "White": F.coalesce(of("_p_white_name"), F.lit("?")), "Black": F.coalesce(of("_p_black_name"), F.lit("?")), "Result": F.coalesce(of("_p_result"), F.lit("*")),
        "Section": known("section"), **{tag: of(f"_p_{c}") for tag, c in PAIRING_TAGS.items()},
        "EventDate": of("_t_start_date"), "EventCountry": of("_t_country _f_country"), "EventType": F.when(F.col("_t"), F.coalesce(of("_t_event_type"), F.lit("tourn"))), "EventRounds": of("_t_rounds"),
    }
    found = F.map_filter(F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    own = F.coalesce("_o", F.from_json(F.lit("{}"), "map<string,string>"))
    rest = F.map_filter(found, lambda k, v: ~F.map_contains_key(own, k))
    return g.select("game_id", F.map_concat(rest, own).alias("headers"))
