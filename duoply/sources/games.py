"""Game files (tags and movetext), pairing tables and other small formats."""

from __future__ import annotations

import io
import re
import zipfile
from contextlib import contextmanager
from datetime import UTC, datetime
from itertools import islice
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoply.functions.records import oriented_result
from duoply.sources.shared import kept

ROSTER = ("Event", "Site", "Date", "Round", "White", "Black", "Result")


#: Tags behind the roster, written where they are known. Fixed order.
OPTIONAL = ("Section", "WhiteElo", "BlackElo", "WhiteTitle", "BlackTitle", "WhiteFideId", "BlackFideId", "ECO", "EventDate", "EventType", "EventRounds", "EventCountry", "Source", "Termination")
#: What exports say of games that aren't done.
INCOMPLETE = "Reconstruction incomplete"


def render_games(moves: DataFrame, headers: DataFrame) -> DataFrame:
    """(game_id, value): seven tags in order, optional ones that headers has, PlyCount, movetext with five moves a line, an end comment without braces (headers.comment), the result last. moves(game_id, ply, move), headers(game_id, tags...)."""
    number = F.when(F.col("ply") % 2 == 0, F.concat(F.when((F.col("ply") % 10 == 0) & (F.col("ply") > 0), "\n").otherwise(""), (F.floor(F.col("ply") / 2) + 1).cast("long").cast("string"), F.lit(". "))).otherwise("")
    body = moves.groupBy("game_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", F.concat(number, F.col("move")).alias("m")))), lambda x: x["m"]), " ").alias("body"), F.count("*").alias("n"))
    safe = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    tag = lambda t, value: F.concat(F.lit(f'[{t} "'), safe(value), F.lit('"]\n'))
    text = lambda t: F.nullif(F.col(t).cast("string"), F.lit(""))
    roster = [tag(t, F.coalesce(F.col(t).cast("string"), F.lit("*" if t == "Result" else "?"))) for t in ROSTER]
    more = [F.coalesce(tag(t, text(t)), F.lit("")) for t in OPTIONAL if t in headers.columns]
    tags = F.concat(*roster, *more, F.lit('[PlyCount "'), F.coalesce("n", F.lit(0)).cast("string"), F.lit('"]\n\n'))
    note = F.coalesce(F.concat(F.lit(" {"), F.translate(text("comment"), "{}", ""), F.lit("}")), F.lit("")) if "comment" in headers.columns else F.lit("")
    return headers.join(body, "game_id", "left").select("game_id", F.concat(tags, F.coalesce("body", F.lit("")), note, F.lit(" "), F.coalesce("Result", F.lit("*")), F.lit("\n")).alias("value"))


def exported(games: DataFrame, moves: DataFrame, confirmed: DataFrame, scope: str, player: str | None = None, include_unverified: bool = False) -> DataFrame:
    """(game_id, round, section, board, done, value): games of an export with their text.

    games(game_id, round, section, board, status, saved, has_result and tags),
    moves and confirmed(game_id, ply, move). A verified, exported or saved game
    is done. Scope `verified` takes these (and unverified ones with a result, if
    asked for) as far as they have moves; `incomplete` all others, with the
    confirmed prefix, a Termination tag and a comment that says where it stops;
    `combined` both; `player` both, of one player's games.
    """
    done = F.col("status").isin("verified", "exported") | F.col("saved")
    g = games.withColumn("done", done)
    if scope == "player":
        g = g.where((F.col("White") == player) | (F.col("Black") == player))
    elif scope == "verified":
        g = g.where("done" + (" or has_result" if include_unverified else "")).join(moves.select("game_id").distinct(), "game_id", "left_semi").withColumn("done", F.lit(True))
    elif scope == "incomplete":
        g = g.where("not done")
    whole = moves.join(g.where("done").select("game_id"), "game_id", "left_semi").select("game_id", "ply", "move")
    part = confirmed.join(g.where("not done").select("game_id"), "game_id", "left_semi").select("game_id", "ply", "move")
    stops = part.groupBy("game_id").agg(F.count("*").alias("_stops"))
    comment = F.when(F.col("_stops").isNull(), "No moves verified - not reviewed").otherwise(F.concat(F.lit("Stopped at ply "), F.col("_stops").cast("string"), F.lit(" - review pending")))
    result = F.when(~F.col("done") & (F.col("Result") == "?"), "*").otherwise(F.col("Result"))
    heads = g.join(stops, "game_id", "left").withColumns({"comment": F.when(~F.col("done"), comment), "Termination": F.when(~F.col("done"), INCOMPLETE), "Result": result})
    return g.select("game_id", F.col("round"), "section", "board", "done").join(render_games(whole.union(part), heads), "game_id")


def write_rounds(exports: DataFrame, path: str, order: tuple[str, ...] = ("section", "board", "game_id")) -> None:
    """A folder a round, with its games in order: ranges of round and order, so that a large round is several files, whose names follow each other in that order."""
    by = ["round", *(F.asc_nulls_last(c) for c in order)]
    exports.repartitionByRange(*by).sortWithinPartitions(*by).select("round", "value").write.partitionBy("round").text(path)


#: What begins a game behind another one in a file.
NEXT_GAME = "\n[Event "


def game_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text): the texts of single games in a folder of game files. Files are split between games, so no value holds a whole file; block sorts the games of a file in their order."""
    raw = spark.read.option("lineSep", NEXT_GAME).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    # only the record that begins a file still has its first tag's name
    text = F.when(F.col("value").rlike(r'^\s*"'), F.concat(F.lit(NEXT_GAME[1:]), F.col("value"))).otherwise(F.col("value"))
    return raw.select(F.col("_metadata.file_path").alias("file"), place.alias("block"), text.alias("text"))


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, tags map, moves array, comment) of every game in a folder of game files (see game_texts); blocks without tags and moves are dropped."""
    whole = game_texts(spark, path)
    tag = r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'
    names, values = (F.regexp_extract_all("text", F.lit(tag), F.lit(i)) for i in (1, 2))
    tags = F.map_from_entries(F.arrays_zip(names.alias("k"), F.transform(values, lambda v: F.regexp_replace(v, r"\\(.)", "$1")).alias("v")))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", tag, " "), r"\{[^}]*\}", " "), r"\d+\.+", " ")
    moves = F.filter(F.split(F.trim(body), r"\s+"), lambda m: ~m.isin("", "*", "?", "1-0", "0-1", "1/2-1/2"))
    comment = F.nullif(F.regexp_extract("text", r"\{([^}]*)\}", 1), F.lit(""))
    return whole.select("file", "block", tags.alias("tags"), moves.alias("moves"), comment.alias("comment")).where((F.size("tags") > 0) | (F.size("moves") > 0))


def pairing_stubs(games: DataFrame) -> DataFrame:
    """(file, round, board, white, black, result, date) of header-only files; a file with any moves is refused whole."""
    from pyspark.sql import Window

    clean = games.withColumn("_moves", F.max((F.size("moves") > 0).cast("int")).over(Window.partitionBy("file"))).where("_moves = 0")
    part = lambda i: F.split_part(F.col("tags")["Round"], F.lit("."), F.lit(i)).try_cast("long")
    date = F.col("tags")["Date"]
    t = clean.select("file", part(1).alias("round"), part(2).alias("board"), F.col("tags")["White"].alias("white"), F.col("tags")["Black"].alias("black"), F.col("tags")["Result"].alias("result"), F.when(date.rlike(r"^\d{4}\."), date).alias("date"))
    return t.where("round is not null and white <> '?' and black <> '?'")


def read_round_csv(spark: SparkSession, path: str) -> DataFrame:
    """(board, white, black, result): columns by lower-cased header; rows without a whole board number or a side are dropped."""
    raw = spark.read.option("header", "true").csv(path)
    t = raw.select(*(F.col(f"`{c}`").alias(c.lower()) for c in raw.columns))
    return t.select(F.col("board").try_cast("long").alias("board"), F.col("`playerw.name`").alias("white"), F.col("`playerb.name`").alias("black"), "result").where("board is not null and white is not null and black is not null")


def read_roster_csv(spark: SparkSession, path: str, rated: tuple[str, ...] = ()) -> DataFrame:
    """(section, number, name, rating, title, fed, fide_id, birthdate, club, sex): columns by header synonyms; number and name are required. Where a roster has both, sections in `rated` take the international rating first, all others the national one."""
    raw = spark.read.option("header", "true").csv(path)
    low = {c.lower().strip().rstrip("."): c for c in raw.columns}

    def pick(*names: str) -> Column:
        return next((F.col(f"`{low[n]}`") for n in names if n in low), F.lit(None).cast("string"))

    if not {"number", "no"} & set(low) or not {"name", "player"} & set(low):
        raise ValueError("a roster needs number and name")
    whole = lambda *names: F.nullif(pick(*names).try_cast("long"), F.lit(0))
    text = lambda *names: F.nullif(F.trim(pick(*names)), F.lit(""))
    home, abroad, section = whole("rtgn"), whole("rtgi"), text("section")
    rating = F.coalesce(whole("rating", "rtg", "elo"), F.when(section.isin(*rated), F.coalesce(abroad, home)).otherwise(F.coalesce(home, abroad)) if rated else F.coalesce(home, abroad))
    known = {"section": section, "number": pick("number", "no").try_cast("long"), "name": F.trim(pick("name", "player")), "rating": rating, "title": text("title"), "fed": text("federation", "fed"), "fide_id": whole("fide_id", "fideid"), "birthdate": text("birthdate"), "club": text("club"), "sex": text("sex")}
    return raw.select(*(v.alias(k) for k, v in known.items())).where("number is not null and name <> ''")


@contextmanager
def opened(path: str):
    """The zip archive of a path as Spark names it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/@"))
    with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
        yield archive


#: Columns of a player table before the rounds' triples: number, sex, title, name, rating, federation, id, birthdate, points, rank (fixed value).
FIXED_COLUMNS = 10


def csv_fields(line: Column) -> Column:
    """The trimmed fields of one CSV line: quoted ones may hold commas, and quotes as two."""
    field = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("[^"]*(?:""[^"]*)*"|[^",]*),'), F.lit(1))
    return F.transform(field, lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)))


def table_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value) of the lines of all files below a folder, loose or in zip archives; place sorts the lines of a file in their order. A file in an archive has the archive's path in front of its own."""

    def members(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as archive:
                    for x in archive.infolist():
                        if x.is_dir():
                            continue
                        with io.TextIOWrapper(archive.open(x), "utf-8-sig", "replace") as text:
                            while lines := list(islice(text, 10_000)):
                                yield pa.RecordBatch.from_pydict({"file": [f"{path}/{x.filename}"] * len(lines), "block": [0] * len(lines), "value": [line.removesuffix("\n") for line in lines]})

    archives = r"(?i)\.zip$"
    loose = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where(~F.col("_metadata.file_path").rlike(archives))
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.col("path").rlike(archives)).mapInArrow(members, "file string, block long, value string")
    return loose.union(packed).select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("place"), "value")


def read_crosstables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables (file, label, value), players (file, number, name, rating, title, fed, fide_id), games (file, round, white, black, white_name, black_name, result)) of player tables as they are exported, below a folder (see table_lines).

    A file has label,value rows, a header that begins with "Player No", and a
    row a player: ten columns, then opponent, colour and result for each round,
    as many as the row has and "Number of rounds" allows. Labels are in lower
    case. An opponent that isn't a number above 0 and a colour other than w or
    b are byes. Of a round's unordered pair the first row of the file counts; a
    name is empty where the table has no such player.
    """
    from pyspark.sql import Window

    lines = kept(table_lines(spark, path).select("file", "place", csv_fields(F.rtrim(F.col("value"))).alias("c")))
    first = F.col("c")[0]
    # a row a file; the number of its header is the file's key, so that no shuffle carries its path
    head = kept(lines.where(first.rlike(r"(?i)^player\s*no$")).groupBy("file").agg(F.min("place").alias("head")).withColumn("key", F.col("head.row")))
    cut = lines.join(F.broadcast(head), "file")
    tables = cut.where((F.col("place") < F.col("head")) & (first != "")).groupBy("file", "key", F.lower(first).alias("label")).agg(F.max_by(F.coalesce(F.try_element_at("c", F.lit(2)), F.lit("")), "place").alias("value"))
    number = F.regexp_extract(first, r"^(\d+)", 1).try_cast("long")
    rows = cut.where((F.col("place") > F.col("head")) & number.isNotNull()).select("file", "key", "place", number.alias("number"), "c")
    at = lambda i: F.coalesce(F.try_element_at("c", F.lit(i + 1)), F.lit(""))
    whole = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("long")
    players = rows.groupBy("file", "number").agg(F.max_by(F.struct(at(3).alias("name"), F.coalesce(whole(at(4)), F.lit(0)).alias("rating"), at(2).alias("title"), at(5).alias("fed"), at(6).alias("fide_id")), "place").alias("p")).select("file", "number", "p.*")
    limit = tables.where("label = 'number of rounds'").select("key", F.coalesce(whole(F.col("value")), F.lit(0)).alias("limit"))
    known = F.greatest(F.floor((F.size("c") - FIXED_COLUMNS) / 3).cast("int"), F.lit(0))
    rounds = F.when(known > 0, F.transform(F.sequence(F.lit(1), F.greatest(known, F.lit(1))), lambda r: F.struct(r.cast("long").alias("round"), *(F.get("c", FIXED_COLUMNS + (r - 1) * 3 + i).alias(n) for i, n in enumerate(("opp", "color", "cell"))))))
    t = rows.select("key", "place", "number", F.explode(rounds).alias("r")).select("key", "place", "number", "r.*").join(limit, "key", "left").where((F.coalesce("limit", F.lit(0)) == 0) | (F.col("round") <= F.col("limit")))
    t = t.withColumns({"opp": whole(F.col("opp")), "color": F.lower("color")}).where("opp > 0 and color in ('w', 'b')")
    white = F.col("color") == "w"
    sides = t.select("key", "round", "place", F.when(white, F.col("number")).otherwise(F.col("opp")).alias("white"), F.when(white, F.col("opp")).otherwise(F.col("number")).alias("black"), oriented_result(F.col("cell"), F.col("color")).alias("result"))
    w = Window.partitionBy("key", "round", F.least("white", "black"), F.greatest("white", "black")).orderBy("place")
    one = sides.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "place")
    names = rows.groupBy("key", "number").agg(F.max_by(at(3), "place").alias("name"))
    named = lambda side: names.select("key", F.col("number").alias(side), F.col("name").alias(f"{side}_name"))
    games = one.join(named("white"), ["key", "white"], "left").join(named("black"), ["key", "black"], "left").join(F.broadcast(head.select("key", "file")), "key")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return tables.drop("key"), players, games.select("file", "round", "white", "black", empty("white_name"), empty("black_name"), "result")


def unpivot_crosstable(players: DataFrame, rounds: int, standings: bool = False) -> DataFrame:
    """(round, white, black, result) from rows (number, name, then opponent, colour, result for each round): one row a round and unordered pair, the first in order of number. In standings (which have a column position) opponents are places in the table, and the first in that order counts."""
    from pyspark.sql import Window

    cells = F.array(*(F.struct(F.lit(r).cast("long").alias("round"), F.col(f"opp{r}").alias("opponent"), F.col(f"col{r}").alias("color"), F.col(f"res{r}").alias("cell")) for r in range(1, rounds + 1)))
    place = F.col("position") if standings else F.col("number")
    t = players.select("number", place.alias("place"), F.explode(cells).alias("c")).select("number", "place", "c.*").where(F.lower("color").isin("w", "b") & (F.col("opponent") > (0 if standings else -1)))
    if standings:
        # a player of several rows has one place
        t = t.join(players.select(F.col("position").alias("opponent"), F.col("number").alias("_number")).distinct(), "opponent").withColumn("opponent", F.col("_number")).drop("_number")
    white = F.lower(F.col("color")) == "w"
    t = t.select("round", F.when(white, F.col("number")).otherwise(F.col("opponent")).alias("white"), F.when(white, F.col("opponent")).otherwise(F.col("number")).alias("black"), oriented_result(F.col("cell"), F.col("color")).alias("result"), "place")
    w = Window.partitionBy("round", F.least("white", "black"), F.greatest("white", "black")).orderBy("place")
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "place")


def read_sections_json(spark: SparkSession, path: str) -> DataFrame:
    """(section, round, white, black, board, result): results are "code;opponent;colour;board"; one game a board, or a pair where the board is 0."""
    from pyspark.sql import Window

    raw = spark.read.schema("Sections array<struct<name:string,Players:array<struct<Pair:int,Name:string,Results:array<string>>>>>").json(path)
    p = raw.select(F.explode("Sections").alias("s")).select(F.col("s.name").alias("section"), F.explode("s.Players").alias("p")).select("section", F.col("p.Pair").alias("pair"), F.posexplode("p.Results").alias("round", "r"))
    bit = lambda i: F.split_part("r", F.lit(";"), F.lit(i))
    t = p.select("section", (F.col("round") + 1).alias("round"), "pair", bit(1).alias("code"), bit(2).try_cast("int").alias("opp"), F.lower(bit(3)).alias("color"), F.coalesce(bit(4).try_cast("int"), F.lit(0)).alias("board")).where("opp > 0 and color in ('w', 'b')")
    white = F.col("color") == "w"
    result = F.when(F.col("code") == "=", "1/2-1/2").when(F.col("code") == "+", F.when(white, "1-0").otherwise("0-1")).when(F.col("code") == "-", F.when(white, "0-1").otherwise("1-0")).otherwise("*")
    t = t.select("section", "round", F.when(white, F.col("pair")).otherwise(F.col("opp")).alias("white"), F.when(white, F.col("opp")).otherwise(F.col("pair")).alias("black"), "board", result.alias("result"), "pair")
    key = F.when(F.col("board") > 0, F.concat(F.lit("b"), F.col("board").cast("string"))).otherwise(F.concat_ws("-", F.least("white", "black").cast("string"), F.greatest("white", "black").cast("string")))
    w = Window.partitionBy("section", "round", key).orderBy("pair")
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "pair")


#: Cells and checksum of each sheet that a log was recorded against.
BASELINE = "array<struct<sheet:int,count:long,checksum:string>>"


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of scans below a folder, loose or in zip archives; contents aren't read, work folders are skipped. A scan in an archive has the archive's path in front of its own."""

    def members(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as archive:
                    found = [x for x in archive.infolist() if not x.is_dir()]
                times = [datetime(*x.date_time, tzinfo=UTC) for x in found]
                yield pa.RecordBatch.from_pydict({"path": [f"{path}/{x.filename}" for x in found], "length": [x.file_size for x in found], "modified": pa.array(times, pa.timestamp("us", "UTC"))})

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    packed = f.where(F.col("path").rlike(r"(?i)\.zip$")).select("path").mapInArrow(members, "path string, length long, modified timestamp")
    return f.union(packed).where(F.col("path").rlike(r"(?i)\.(jpg|jpeg|png|tif|tiff|pdf)$") & ~F.col("path").rlike(r"(_work|_normalized)/"))


def file_kind(path: Column, first_line: Column) -> Column:
    """Kind of a tournament file: by its name first, then by its header line."""
    name, head = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(F.coalesce(first_line, F.lit("")))
    roster = head.contains("fide_id") & (head.contains("number") | head.contains("place"))
    return (
        F.when(name.endswith(".pgn") | head.rlike(r"^\s*\[event\b"), "pgn").when(name.rlike("crosstable|tiebreak|standings|ranking|berger"), "crosstable").when(name.rlike("all.?rounds"), "all_rounds").when(name.rlike("roster|players"), "roster")
        .when(name.rlike("round|pairing"), "round").when(head.contains("playerw.name") | head.rlike(r'(^|,)\s*"?board"?\s*,'), "round").when(roster, "roster").when(head.rlike(r"^rank\b"), "crosstable").otherwise("all_rounds")
    )


def file_round(path: Column) -> Column:
    """Round number in a file's name, or null."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?i)round\s*[_-]?\s*(\d+)", 1), F.lit("")).cast("long")


def file_section(path: Column) -> Column:
    """Section in a file's name, in front of what kind of list it is; empty without any."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", "")
    return F.regexp_extract(stem, r"(?i)_([^_]+)_(?:Pairings|Crosstable|Standings|Berger|Ranking)", 1)


def scatter(files: DataFrame, folder: str) -> int:
    """Writes files(path, content binary) below a folder, each under its own name, from the executors; gives their number."""

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            n = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
                n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

    return files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def pack(files: DataFrame, folder: str, most: int = 10_000, size: int = 1 << 26) -> int:
    """Writes files(path, content binary) into zip archives in a folder, from the executors; gives their number. An archive has at most `most` files and about `size` bytes, and is named by its task, so that a repeated task writes it again."""

    def put(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, k, n = TaskContext.get().partitionId(), 0, 0
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        row = next(rows, None)
        while row:
            with zipfile.ZipFile(whole := io.BytesIO(), "w") as archive:
                inside = 0
                while row and inside < most and whole.tell() < size:
                    archive.writestr(*row)
                    inside, row = inside + 1, next(rows, None)
            with store.open_output_stream(f"{root}/{task}-{k}.zip") as out:
                out.write(whole.getbuffer())
            k, n = k + 1, n + inside
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def encode_logits(cells: DataFrame, vocab: int = 8) -> DataFrame:
    """(file, content): a file's count of cells, their shape, and half-precision values. cells(file, cell, values) of at most some hundred cells a file; `vocab` symbols a frame, or a column of that name."""

    def run(key, pdf):
        v = np.stack([np.asarray(x, dtype="<f2") for x in pdf.sort_values("cell")["values"]])
        wide = int(pdf["vocab"].iloc[0]) if "vocab" in pdf else vocab
        return pd.DataFrame({"file": [key[0]], "content": [np.array([len(v), v.shape[1] // wide, wide], dtype="<u4").tobytes() + v.tobytes()]})

    return cells.groupBy("file").applyInPandas(run, "file string, content binary")


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, frames, symbols, cell, values) of all *.logits files below a folder; those that are shorter than their header says give no rows."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.logits").load(path).select("path", "content")

    def run(frames):
        for f in frames:
            for name, blob in zip(f["path"], f["content"]):
                head = np.frombuffer(blob[:12], dtype="<u4").astype(np.int64)
                if len(head) < 3 or len(blob) < 12 + 2 * int(head.prod()):
                    continue
                v = np.frombuffer(blob[12 : 12 + 2 * int(head.prod())], dtype="<f2").astype(np.float32).reshape(head[0], -1)
                yield pd.DataFrame({"file": name.rpartition("/")[2].removesuffix(".logits"), "n": head[0], "frames": head[1], "symbols": head[2], "cell": np.arange(head[0]), "values": [x.tolist() for x in v]})

    return blobs.mapInPandas(run, "file string, n long, frames int, symbols int, cell long, values array<float>")


def logits_by_ply(logits: DataFrame, readings: DataFrame) -> DataFrame:
    """(game_id, ply, sheet, frames, symbols, values): each ply's cell. readings(game_id, sheet, file, cell, ply) in the order of the cells; a file whose count of cells differs from its reading's is refused whole, so is one whose shape differs from that of the game's first sheet; of a repeated ply the first sheet counts, and its first cell."""
    from pyspark.sql import Window

    counts = readings.groupBy("game_id", "sheet", "file").agg(F.count("*").alias("_n"))
    shapes = logits.select("file", "n", "frames", "symbols").distinct().join(counts, "file").where("n = _n")
    first = Window.partitionBy("game_id").orderBy("sheet")
    good = shapes.withColumns({"_f": F.first("frames").over(first), "_s": F.first("symbols").over(first)}).where("frames = _f and symbols = _s").select("game_id", "sheet", "file", "frames", "symbols")
    cells = readings.join(good, ["game_id", "sheet", "file"]).join(logits.select("file", "cell", "values"), ["file", "cell"])
    one = Window.partitionBy("game_id", "ply").orderBy("sheet", "cell")
    return cells.withColumn("_r", F.row_number().over(one)).where("_r = 1").select("game_id", "ply", "sheet", "frames", "symbols", "values")


def read_grid_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_id, version, layout, page, col, color, x_frac, y_frac): cell centres as fractions of the image."""
    schema = "sheet_id long, version int, layout string, imageWidth double, imageHeight double, cells array<struct<page:int,num:long,color:string,bbox:struct<x:double,y:double,w:double,h:double>>>"
    t = spark.read.schema(schema).json(path).select("sheet_id", "version", "layout", "imageWidth", "imageHeight", F.explode("cells").alias("c"))
    return t.select("sheet_id", "version", "layout", "c.page", F.col("c.num").alias("col"), "c.color", ((F.col("c.bbox.x") + F.col("c.bbox.w") / 2) / F.col("imageWidth")).alias("x_frac"), ((F.col("c.bbox.y") + F.col("c.bbox.h") / 2) / F.col("imageHeight")).alias("y_frac"))


def read_edit_logs(spark: SparkSession, path: str, baselines: DataFrame, known: int = 1) -> DataFrame:
    """(game_id, state, entries): valid logs; stale ones (bad JSON, wrong format, no entries, or a baseline other than that of baselines(game_id, baseline: count and checksum by sheet)), which are set aside; those of a newer version, which are left as they are."""
    schema = f"game_id long, format string, version int, baseline {BASELINE}, entries array<struct<seq:long,op:string,pos:long,event_id:long>>, _corrupt_record string"
    t = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    t = t.withColumn("game_id", F.coalesce("game_id", F.regexp_extract("_corrupt_record", r'"game_id":\s*(\d+)', 1).try_cast("long"))).join(baselines.select("game_id", F.col("baseline").alias("_now")), "game_id", "left")
    bad = F.col("_corrupt_record").isNotNull() | ~F.col("format").eqNullSafe("edit-log") | F.col("entries").isNull()
    state = F.when(bad, "stale").when(F.col("version") > known, "newer").when(~F.col("baseline").eqNullSafe(F.col("_now")), "stale").otherwise("valid")
    return t.select("game_id", state.alias("state"), "entries")
