"""Corpora of reading files: one text a game and sheet, one line a half-move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between the records of a packed file.
RECORD = "\x1e"
LINE = r"^(\d+)\.([WB])\s+(.+)$"


def _shown(conf: Column, default: float) -> Column:
    """A confidence with up to six decimals; 0 and null give the default."""
    return F.regexp_replace(F.format_string("%.6f", F.coalesce(F.nullif(conf, F.lit(0.0)), F.lit(default))), r"\.?0+$", "")


def render_readings(c: DataFrame, page_plies: int | None = None, layout: str | None = None) -> DataFrame:
    """(game_id, sheet, value): the file of each game and sheet, in ply order, with optional page and layout headers."""
    pair = F.concat_ws(" ", F.col("move"), F.when(F.col("rk") == 0, _shown(F.col("conf"), 0.9)).otherwise(_shown(F.col("conf"), 0.1)))
    cells = c.groupBy("game_id", "sheet", "ply").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", pair.alias("p")))), lambda x: x["p"]), " ").alias("pairs"))
    line = F.concat((F.floor(F.col("ply") / 2) + 1).cast("long").cast("string"), F.when(F.col("ply") % 2 == 0, ".W ").otherwise(".B "), F.col("pairs"))
    files = cells.groupBy("game_id", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"), F.count("*").alias("n"))
    head = F.lit("")
    if page_plies:
        pages = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / page_plies)), lambda k: F.least(F.lit(page_plies), F.col("n") - k * page_plies).cast("long").cast("string"))
        head = F.when(F.col("n") > page_plies, F.concat(F.lit("# pages: "), F.array_join(pages, ","), F.lit("\n"))).otherwise("")
    if layout:
        head = F.concat(head, F.lit(f"# layout: {layout}\n"))
    return files.select("game_id", "sheet", F.concat(head, F.col("value")).alias("value"))


def write_readings(files: DataFrame, path: str) -> None:
    """Many readings a file, each a record that begins with its game and sheet, so that millions of games don't make millions of files."""
    key = F.concat_ws(" ", F.lit("# file:"), F.col("game_id").cast("string"), F.col("sheet").cast("string"))
    files.select(F.concat(key, F.lit("\n"), F.col("value")).alias("value")).write.option("lineSep", RECORD).text(path)


def records(raw: DataFrame, *more: Column) -> DataFrame:
    """(_game, _sheet, value, and more columns): the readings in records of files (value), packed as write_readings() does it or one a file under game_id=…/sheet=… folders."""
    file, head = F.col("_metadata.file_path"), r"^# file: (\d+) (\d+)\n"
    of = lambda name, i: F.coalesce(F.nullif(F.regexp_extract("value", head, i), F.lit("")), F.regexp_extract(file, rf"{name}=(\d+)", 1))
    return raw.select(of("game_id", 1).cast("long").alias("_game"), of("sheet", 2).cast("int").alias("_sheet"), F.regexp_replace("value", head, "").alias("value"), *more)


def _records(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.option("recursiveFileLookup", "true").option("lineSep", RECORD).text(path))


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, sheet, ply, rk, move, conf) of the readings below a folder; see parse_readings."""
    return parse_readings(_records(spark, path))


def parse_readings(found: DataFrame) -> DataFrame:
    """(game_id, sheet, ply, rk, move, conf) of records(); lines that aren't half-moves are skipped, bad and zero confidences get their defaults, an odd last token is dropped."""
    rows = found.select("_game", "_sheet", F.explode(F.split("value", "\n")).alias("value"))
    lines = rows.where(F.col("value").rlike(LINE))
    part = lambda i: F.regexp_extract("value", LINE, i)
    tokens = F.split(F.trim(part(3)), r"\s+")
    conf = lambda i, default: F.coalesce(F.nullif(F.try_element_at(tokens, i).try_cast("double"), F.lit(0.0)), F.lit(default))
    pairs = F.when(F.size(tokens) > 3, F.transform(F.sequence(F.lit(3), F.size(tokens) - 1, F.lit(2)), lambda i: F.struct(F.element_at(tokens, i).alias("move"), conf(i + 1, 0.1).alias("conf")))).otherwise(F.array())
    every = F.concat(F.array(F.struct(F.element_at(tokens, 1).alias("move"), conf(F.lit(2), 0.9).alias("conf"))), pairs.cast("array<struct<move:string,conf:double>>"))
    ply = ((part(1).cast("long") - 1) * 2 + F.when(part(2) == "B", 1).otherwise(0)).cast("long")
    return lines.select(F.col("_game").alias("game_id"), F.col("_sheet").alias("sheet"), ply.alias("ply"), F.posexplode(every).alias("rk", "c")).select("game_id", "sheet", "ply", "rk", "c.move", "c.conf")


def read_reading_headers(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, sheet, layout, page, first, last): pages of each file as ranges of cell numbers; one page where there is no header."""
    whole = _records(spark, path)
    head = F.regexp_extract("value", r"(?s)^((?:#[^\n]*\n)*)", 1)
    counts = F.transform(F.split(F.regexp_extract(head, r"# pages: ([0-9,]+)", 1), ","), lambda x: x.cast("long"))
    cells = F.size(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+)\.[WB]\s"), F.lit(1))).cast("long")
    sizes = F.when(F.regexp_extract(head, r"# pages: ([0-9,]+)", 1) != "", counts).otherwise(F.array(cells))
    ends = F.transform(F.sequence(F.lit(1), F.size("sizes")), lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    t = whole.select("_game", "_sheet", F.nullif(F.regexp_extract(head, r"# layout: ([^\n]+)", 1), F.lit("")).alias("layout"), sizes.alias("sizes")).withColumn("ends", ends)
    return t.select(F.col("_game").alias("game_id"), F.col("_sheet").alias("sheet"), "layout", F.posexplode("ends").alias("page", "last"), "sizes").select("game_id", "sheet", "layout", (F.col("page") + 1).alias("page"), (F.col("last") - F.element_at("sizes", F.col("page") + 1)).alias("first"), F.col("last"))
