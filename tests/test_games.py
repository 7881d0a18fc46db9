"""Game files that are split between tasks, and rounds of several files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duoply.sources import games as G
from duoply.sources.shared import new_folder


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def games_of(spark, n: int):
    games = spark.range(n).select(F.col("id").alias("game_id"), (F.col("id") % 2).alias("round"), F.lit("A").alias("section"), (F.lit(n) - F.col("id")).alias("board"), F.lit(True).alias("done"))
    heads = games.select("game_id", *(F.lit(None).cast("string").alias(t) for t in G.ROSTER if t != "White"), F.concat(F.lit('a "b" '), F.col("game_id").cast("string")).alias("White"))
    moves = games.select("game_id", F.explode(F.sequence(F.lit(0), F.col("game_id").cast("int") % 23)).alias("ply")).withColumn("move", F.concat(F.lit("e"), F.col("ply").cast("string")))
    return games.join(G.render_games(moves, heads), "game_id")


def test_a_file_in_many_splits(spark, small_splits):
    path, n = new_folder(spark), 300
    games_of(spark, n).orderBy("game_id").coalesce(1).select("value").write.text(path)
    assert spark.read.option("lineSep", G.NEXT_GAME).text(path).rdd.getNumPartitions() > 5
    got = G.read_games(spark, path).orderBy("file", "block").select(F.col("tags")["White"], F.col("tags")["Event"], F.size("moves")).collect()
    assert [tuple(r) for r in got] == [(f'a "b" {k}', "?", k % 23 + 1) for k in range(n)]


def test_first_records_and_blocks_without_games(spark):
    path = new_folder(spark)
    texts = ['[Event "x"]\n[White "w"]\n\n1. e4 *\n', "1. d4 d5 *\n", '[Event "a"]\n[White "v"]\n\n{[Event in a comment}\n*\n[Event  "b"]\n[White "u"]\n\n*\n', ""]
    files = spark.createDataFrame([(f"{k}.pgn", bytearray(t.encode())) for k, t in enumerate(texts)], "path string, content binary")
    G.scatter(files, path)
    got = G.read_games(spark, path).orderBy("file", "block").select(F.col("tags")["Event"].alias("e"), F.col("tags")["White"].alias("w"), "moves", "comment").collect()
    assert [tuple(r) for r in got] == [("x", "w", ["e4"], None), (None, None, ["d4", "d5"], None), ("a", "v", [], "[Event in a comment"), ("b", "u", [], None)]


def test_rounds_keep_their_order_over_files(spark):
    path, n = new_folder(spark), 400
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        G.write_rounds(games_of(spark, n), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    g = G.read_games(spark, path).withColumn("round", F.regexp_extract("file", r"round=(\d+)", 1).cast("int"))
    assert g.groupBy("round").agg(F.count_distinct("file").alias("files")).agg(F.max("files")).first()[0] > 1
    got = g.orderBy("round", "file", "block").select("round", F.regexp_extract(F.col("tags")["White"], r"(\d+)$", 1).cast("int")).collect()
    assert [tuple(r) for r in got] == [(r, k) for r in (0, 1) for k in range(n - 2 + r, -1, -2)]


def test_standings_join_a_player_of_many_rows_once(spark):
    import time

    n = 40_000
    one = spark.range(n).selectExpr("0L AS number", "0L AS position", "id + 1 AS opp1", "'w' AS col1", "'1' AS res1")
    others = spark.range(n).selectExpr("id + 1 AS number", "id + 1 AS position", "0L AS opp1", "'b' AS col1", "'0' AS res1")
    began = time.time()
    rows = G.unpivot_crosstable(one.union(others), 1, standings=True)
    assert rows.count() == n and rows.where("white = 0 and result = '1-0'").count() == n
    assert time.time() - began < 60  # by pairs of rows these are 1.6 billion


def test_an_inventory_looks_into_archives(spark):
    folder = new_folder(spark)
    files = [("a/one.PNG", b"123"), ("a b/t%41wo+.jpg", b""), ("a/x_work/no.png", b"1"), ("a/no.txt", b"12"), ("a/three.pdf", b"12345")]
    frame = lambda rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").coalesce(1)
    assert G.scatter(frame(files[:1]), f"{folder}/loose") == 1 and G.pack(frame(files), packed := new_folder(spark), most=2) == 5
    odd = Path(folder.removeprefix("file:")) / "in z%41+"
    odd.mkdir()
    for file in Path(packed.removeprefix("file:")).glob("*.zip"):
        (odd / file.name).write_bytes(file.read_bytes())
    found = G.file_inventory(spark, folder).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in found) == [("one.PNG", 3), ("one.PNG", 3), ("t%41wo+.jpg", 0), ("three.pdf", 5)]
    assert sum(".zip/" in r.path for r in found) == 3 and all(r.modified.year > 1979 for r in found)


def test_the_inventory_of_many_files_writes_few(spark, monkeypatch):
    from duoply.plans import corpora

    made = []
    monkeypatch.setattr(corpora, "new_folder", lambda s: made.append(new_folder(s)) or made[-1])
    assert corpora.src09_file_inventory(spark, "/root/testdata/sf0.001").count() > 1000
    assert sum(x.is_file() for x in Path(made[0].removeprefix("file:")).rglob("*")) < 200


def test_tables_in_archives_are_read_as_loose_ones(spark):
    head = "﻿Number of Rounds,1\r\nPlayer No,Sex,Title,Name,Rating,Federation,FIDE ID,Birthdate,Points,Rank,R1\r\n"
    rows = '1,,FM,"One, ""A""",1501,ABC,77,,1,1,2,w,1,2,B,1\n2,,,Two,1502,,,,0,2,1,b,0,1,w,0\r2,,, Again ,1502,,,,0,2\n'
    files = [("a/t.csv", head + rows), ("b c/t%41+.csv", head.replace("1", "0") + rows), ("none.csv", ""), ("headless.csv", rows)]
    frame = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary").coalesce(1)
    loose, packed, both = new_folder(spark), new_folder(spark), new_folder(spark)
    G.scatter(frame, loose), G.pack(frame, packed, most=2)
    G.scatter(frame.where("path like 'a/%'"), both), G.pack(frame.where("path not like 'a/%'"), f"{both}/inner")
    read = lambda folder: [sorted(tuple(r)[1:] for r in df.collect()) for df in G.read_crosstables(spark, folder)]
    want = read(loose)
    assert read(packed) == want and read(both) == want
    assert want[0] == [("number of rounds", "0"), ("number of rounds", "1")] and want[2] == [(1, 1, 2, 'One, "A"', "Again", "1-0")] * 2 + [(2, 2, 1, "Again", 'One, "A"', "0-1")]


def test_the_tables_of_a_query_are_few_files(spark, monkeypatch):
    from duoply.plans import corpora

    made = []
    monkeypatch.setattr(corpora, "new_folder", lambda s: made.append(new_folder(s)) or made[-1])
    tables = corpora.src05_crosstable_players(spark, "/root/testdata/sf0.01").select("file").distinct().count()
    assert tables > 50 and sum(x.is_file() for x in Path(made[0].removeprefix("file:")).rglob("*")) < tables
