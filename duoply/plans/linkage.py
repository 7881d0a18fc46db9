"""Queries over pairings, files, fixes, decisions and edits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoply import config as C
from duoply.fixtures import oracle, table, view
from duoply.functions.records import layout_matches, normalize_result, person_key
from duoply.operators import evidence as E
from duoply.operators import link as L
from duoply.operators.detect import attention
from duoply.operators import review as V
from duoply.plans.columns import LAYOUTS, _layouts

QUERIES, ORACLES = {}, {}


def query(sql: str, views: str = "pairings"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(views, sql)
        return f

    return add


def games_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games by section, round and board: sections whole, in lower case, as a part of the name, or unknown; some boards count from one."""
    f, k = view(spark, sf_dir, "files"), (F.col("file_id") % 4).cast("string")
    style = F.col("file_id") % 5
    section = F.when(style == 1, F.concat(F.lit("s"), k)).when(style == 2, k).when(style == 3, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("S"), k))
    return f.select(F.col("file_id").alias("game_id"), section.alias("section"), (F.col("file_id") % 9 + 1).alias("round"), (F.floor(F.col("file_id") / 40) + 1).cast("long").alias("board"), (F.col("file_id") % 6 == 0).alias("from_directory"))


GAMES = "games AS (SELECT file_id AS game_id, CASE file_id % 5 WHEN 1 THEN 's' WHEN 2 THEN '' WHEN 3 THEN 'X' ELSE 'S' END || (file_id % 4)::VARCHAR AS section, file_id % 9 + 1 AS round, file_id // 40 + 1 AS board, file_id % 6 = 0 AS from_directory FROM files)"
CHOICES = """labels AS (SELECT DISTINCT lower(section) AS wanted, round FROM games), named AS (SELECT DISTINCT section, round FROM pairings),
choices AS (SELECT wanted, l.round, n.section FROM labels l JOIN named n ON l.round = n.round QUALIFY contains(lower(n.section), wanted) OR NOT bool_or(contains(lower(n.section), wanted)) OVER (PARTITION BY l.round, wanted))"""
MATCH = f"""{GAMES}, {CHOICES}, seats AS (SELECT *, min(board) OVER (PARTITION BY section, round) AS low, count(*) OVER (PARTITION BY section, round) AS n FROM pairings),
gc AS (SELECT g.game_id, g.board, c.section, c.round FROM games g JOIN choices c ON lower(g.section) = c.wanted AND g.round = c.round),
m0 AS (SELECT g.game_id, s.pairing_id, 'board' AS how, 0 AS p, s.section FROM gc g JOIN seats s ON g.section = s.section AND g.round = s.round AND g.board = s.board
  UNION ALL SELECT g.game_id, s.pairing_id, 'offset', 1, s.section FROM gc g JOIN seats s ON g.section = s.section AND g.round = s.round AND s.low > 1 AND g.board = s.board - s.low + 1 AND g.board BETWEEN 1 AND s.n),
matched AS (SELECT game_id, pairing_id, how FROM m0 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY p, section, pairing_id) = 1)"""


@query(f"WITH {MATCH} SELECT * FROM matched", "files pairings")
def jn07_match_games_to_pairings(spark, sf_dir):
    return L.match_games(games_of(spark, sf_dir), view(spark, sf_dir, "pairings"))


def trimmed(spark, sf_dir):
    """Games of one board more or less than pairings, so that some rounds zip and some don't."""
    p = view(spark, sf_dir, "pairings")
    g = p.where("pairing_id % 5 <> 0 or section = 'S1'").select((F.col("pairing_id") + 1000000).alias("game_id"), F.when(F.col("pairing_id") % 2 == 0, F.lower("section")).otherwise(F.col("section")).alias("section"), "round", (F.coalesce("board", F.lit(0)) + 100).alias("board"), (F.col("pairing_id") % 7 == 1).alias("from_directory"))
    return g, p, p.where("pairing_id % 3 = 0 and pairing_id % 5 <> 0").select((F.col("pairing_id") + 1000000).alias("game_id"), "pairing_id")


@query(f"""WITH games AS (SELECT pairing_id + 1000000 AS game_id, CASE WHEN pairing_id % 2 = 0 THEN lower(section) ELSE section END AS section, round, coalesce(board, 0) + 100 AS board, pairing_id % 7 = 1 AS from_directory FROM pairings WHERE pairing_id % 5 <> 0 OR section = 'S1'), m AS (SELECT pairing_id + 1000000 AS game_id, pairing_id FROM pairings WHERE pairing_id % 3 = 0 AND pairing_id % 5 <> 0), {CHOICES},
a AS (SELECT lower(section) AS wanted, round, game_id, row_number() OVER (PARTITION BY lower(section), round ORDER BY board, game_id) AS k, count(*) OVER (PARTITION BY lower(section), round) AS n FROM games WHERE game_id NOT IN (SELECT game_id FROM m)),
b AS (SELECT c.wanted, c.round, pairing_id, row_number() OVER (PARTITION BY c.wanted, c.round ORDER BY board NULLS LAST, pairing_id) AS k, count(*) OVER (PARTITION BY c.wanted, c.round) AS n FROM pairings p JOIN choices c ON p.section = c.section AND p.round = c.round WHERE pairing_id NOT IN (SELECT pairing_id FROM m)),
u AS (SELECT game_id, pairing_id, false AS via_order FROM m UNION ALL SELECT game_id, pairing_id, true FROM a JOIN b USING (wanted, round, k, n))
SELECT game_id, pairing_id, via_order, CASE WHEN p.board <> g.board AND NOT from_directory THEN p.board ELSE g.board END AS board, CASE WHEN p.board <> g.board AND NOT from_directory THEN g.board END AS scan_board FROM u JOIN games g USING (game_id) JOIN pairings p USING (pairing_id)""")
def jn08_attach_by_order(spark, sf_dir):
    return L.attach(*trimmed(spark, sf_dir))


@query("""WITH d AS (SELECT round, least(lower(white_name), lower(black_name)) AS a, greatest(lower(white_name), lower(black_name)) AS b, min(board) AS db FROM pairings WHERE board IS NOT NULL GROUP BY ALL)
SELECT pairing_id, coalesce(p.board, d.db) AS board FROM pairings p LEFT JOIN d ON p.round = d.round AND least(lower(white_name), lower(black_name)) = d.a AND greatest(lower(white_name), lower(black_name)) = d.b""")
def jn09_donate_boards(spark, sf_dir):
    p = view(spark, sf_dir, "pairings")
    return L.donate_boards(p, p).select("pairing_id", "board")


def titled(pairings: DataFrame) -> DataFrame:
    """Pairings with titles, federations and ids, some of which are missing."""
    k = F.col("pairing_id")
    more = {}
    for side, no in (("white", F.col("white_sno")), ("black", F.col("black_sno"))):
        more |= {f"{side}_title": F.when((no + k) % 3 == 0, "").when(no % 2 == 0, "FM"), f"{side}_fed": F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("F"), (no % 9).cast("string"))), f"{side}_fide_id": F.when(k % 5 == 0, 0).otherwise(no * 100 + 7)}
    return pairings.withColumns(more)


SIDES = "CASE WHEN ({0} + pairing_id) % 3 = 0 THEN '' WHEN {0} % 2 = 0 THEN 'FM' END AS {1}_title, CASE WHEN pairing_id % 4 <> 0 THEN 'F' || ({0} % 9) END AS {1}_fed, CASE WHEN pairing_id % 5 = 0 THEN 0 ELSE {0} * 100 + 7 END AS {1}_fide_id"
TITLED = f"titled AS (SELECT *, {SIDES.format('white_sno', 'white')}, {SIDES.format('black_sno', 'black')} FROM pairings)"
FILLED = ", ".join(f"coalesce(nullif({s}_{f}, {e}), {s[0]}n.{f}, {s[0]}m.{f}) AS {s}_{f}" for s in ("white", "black") for f, e in (("rtg", "0"), ("title", "''"), ("fed", "''"), ("fide_id", "0")))
BEST = "max(nullif(white_rtg, 0)) AS rtg, max(nullif(white_title, '')) AS title, max(nullif(white_fed, '')) AS fed, max(nullif(white_fide_id, 0)) AS fide_id"


def roster_of(pairings: DataFrame) -> DataFrame:
    return titled(pairings).select("section", F.col("white_sno").alias("number"), F.col("white_name").alias("name"), *(F.col(f"white_{f}").alias(f) for f in L.PLAYER))


@query(f"""WITH {TITLED}, n AS (SELECT section, white_sno AS number, {BEST} FROM titled GROUP BY ALL), m AS (SELECT lower(white_name) AS k, {BEST} FROM titled GROUP BY ALL)
SELECT pairing_id, {FILLED} FROM titled p LEFT JOIN n wn ON wn.section = p.section AND wn.number = p.white_sno LEFT JOIN m wm ON wm.k = lower(p.white_name) LEFT JOIN n bn ON bn.section = p.section AND bn.number = p.black_sno LEFT JOIN m bm ON bm.k = lower(p.black_name)""")
def jn10_backfill_players(spark, sf_dir):
    p = view(spark, sf_dir, "pairings")
    return L.backfill_players(titled(p), roster_of(p)).select("pairing_id", *(f"{s}_{f}" for s in ("white", "black") for f in L.PLAYER))


def sources(spark, sf_dir):
    """Pairings from three sources: one without boards, one without some results, numbers and names, one with other boards and ratings."""
    p, k = view(spark, sf_dir, "pairings").withColumn("result", normalize_result(F.col("result_raw"))), F.col("pairing_id")
    a = p.withColumns({"source": F.lit("a"), "board": F.lit(None).cast("long"), "black_name": F.when(k % 3 != 0, F.col("black_name")).otherwise("")})
    b = p.where("pairing_id % 2 = 0").withColumns({"source": F.lit("b"), "result": F.lit("*"), "white_sno": F.when(k % 10 != 0, F.col("white_sno")), "white_rtg": F.lit(0).cast("long"), "played_at": F.when(k % 4 == 0, F.col("played_at"))})
    c = p.where("pairing_id % 5 = 1").withColumns({"source": F.lit("c"), "board": F.col("board") + 500, "white_rtg": F.col("white_rtg") + 1, "result": F.lit("")})
    return a.unionByName(b).unionByName(c)


PARTS = """p0 AS (SELECT *, replace(replace(result_raw, ' ', ''), '½-½', '1/2-1/2') AS result FROM pairings),
u AS (SELECT 'a' AS source, pairing_id, section, round, white_sno, black_sno, NULL::BIGINT AS board, white_name, CASE WHEN pairing_id % 3 <> 0 THEN black_name ELSE '' END AS black_name, white_rtg, black_rtg, result, played_at FROM p0
  UNION ALL SELECT 'b', pairing_id, section, round, CASE WHEN pairing_id % 10 <> 0 THEN white_sno END, black_sno, board, white_name, black_name, 0, black_rtg, '*', CASE WHEN pairing_id % 4 = 0 THEN played_at END FROM p0 WHERE pairing_id % 2 = 0
  UNION ALL SELECT 'c', pairing_id, section, round, white_sno, black_sno, board + 500, white_name, black_name, white_rtg + 1, black_rtg, '', played_at FROM p0 WHERE pairing_id % 5 = 1)"""
FIRSTS = ", ".join(f"coalesce(arg_min({f}, o) FILTER ({f} IS NOT NULL{more}), arg_min({f}, o)) AS {f}" for f, more in (("white_name", " AND trim(white_name) <> ''"), ("black_name", " AND trim(black_name) <> ''"), ("white_rtg", " AND white_rtg <> 0"), ("black_rtg", " AND black_rtg <> 0"), ("result", " AND trim(result) NOT IN ('', '*')"), ("played_at", "")))


@query(f"""WITH {PARTS},
k AS (SELECT *, least(white_sno, black_sno) AS lo, greatest(white_sno, black_sno) AS hi, CASE WHEN white_sno IS NULL OR black_sno IS NULL THEN pairing_id END AS alone, source || lpad(pairing_id::VARCHAR, 12, '0') AS rk FROM u),
j AS (SELECT *, CASE WHEN min(CASE WHEN board IS NOT NULL THEN rk END) OVER (PARTITION BY section, round, lo, hi, alone) = rk THEN '0' ELSE '1' END || rk AS o FROM k)
SELECT * EXCLUDE (played) FROM (SELECT section, round, lo AS low_no, hi AS high_no, arg_min(board, o) FILTER (board IS NOT NULL) AS board, {FIRSTS.replace("AS played_at", "AS played")}, strftime(played, '%Y.%m.%d') AS played_at, count(*) AS sources FROM j GROUP BY section, round, lo, hi, alone)""")
def jn11_merge_sources(spark, sf_dir):
    return L.merge_sources(sources(spark, sf_dir)).withColumn("played_at", F.date_format("played_at", "yyyy.MM.dd"))


@query("""WITH h AS (SELECT pairing_id AS source, 'k' || (white_sno % 50) AS key, CASE WHEN pairing_id % 3 = 0 THEN '' WHEN pairing_id % 3 = 1 OR white_sno % 7 = 0 THEN CASE WHEN black_sno % 2 = 0 THEN '?' ELSE '-' END ELSE white_name END AS value FROM pairings)
SELECT key, coalesce(arg_min(value, source) FILTER (value NOT IN ('?', '-')), arg_max(value, source)) AS value FROM h WHERE trim(value) <> '' GROUP BY ALL""")
def jn11_merge_headers(spark, sf_dir):
    k = F.col("pairing_id")
    value = F.when(k % 3 == 0, "").when((k % 3 == 1) | (F.col("white_sno") % 7 == 0), F.when(F.col("black_sno") % 2 == 0, "?").otherwise("-")).otherwise(F.col("white_name"))
    return L.merge_headers(view(spark, sf_dir, "pairings").select(k.alias("source"), F.concat(F.lit("k"), (F.col("white_sno") % 50).cast("string")).alias("key"), value.alias("value")))


@query(f"""WITH {TITLED} SELECT section, white_sno AS number, arg_min(white_name, pairing_id) FILTER (trim(white_name) <> '') AS name, arg_min(white_rtg, pairing_id) FILTER (white_rtg <> 0) AS rtg, arg_min(white_title, pairing_id) FILTER (white_title <> '') AS title, arg_min(white_fed, pairing_id) FILTER (white_fed <> '') AS fed, arg_min(white_fide_id, pairing_id) FILTER (white_fide_id <> 0) AS fide_id FROM titled GROUP BY ALL""")
def jn11_merge_players(spark, sf_dir):
    p = titled(view(spark, sf_dir, "pairings"))
    return L.merge_players(p.select(F.col("pairing_id").alias("source"), "section", F.col("white_sno").alias("number"), F.col("white_name").alias("name"), *(F.col(f"white_{f}").alias(f) for f in L.PLAYER)))


@query("""WITH r AS (SELECT game_id, CASE sheet WHEN 1 THEN 'game' ELSE 'round' END AS source, max(ply * (3 - sheet) % 50) AS modified, string_agg(move, ' ' ORDER BY ply) AS text, max(ply) % 5 <> 0 AS finished FROM candidates WHERE rk = 0 GROUP BY game_id, sheet)
SELECT game_id, source, modified FROM r WHERE finished QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY modified DESC, source) = 1""", "candidates")
def jn12_newest_record_wins(spark, sf_dir):
    t = view(spark, sf_dir, "candidates").where("rk = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", "move"))), lambda x: x["move"]), " ")
    r = t.groupBy("game_id", "sheet").agg(F.max(F.col("ply") * (3 - F.col("sheet")) % 50).alias("modified"), text.alias("text"), (F.max("ply") % 5 != 0).alias("finished"))
    return L.newest(r.withColumn("source", F.when(F.col("sheet") == 1, "game").otherwise("round"))).select("game_id", "source", "modified")


@query(f"{LAYOUTS} SELECT file_id FROM l WHERE NOT CASE WHEN cached IS NULL THEN true WHEN contains(cached, '@') THEN cached = current ELSE cached = 'grid8x2' END AND file_id % 7 <> 0", "files")
def jn18_stale_layouts(spark, sf_dir):
    f = _layouts(spark, sf_dir)
    finished = f.where("file_id % 7 = 0").select("file_id")
    return f.where(~layout_matches(F.col("cached"), F.col("current"))).join(finished, "file_id", "left_anti").select("file_id")


@query("SELECT section, round, count(*) AS games FROM pairings GROUP BY ROLLUP (section, round)")
def agg04_catalogue_counts(spark, sf_dir):
    return view(spark, sf_dir, "pairings").rollup("section", "round").agg(F.count("*").alias("games"))


@query("SELECT player, count(*) AS games FROM (SELECT lower(white_name) AS player FROM pairings UNION ALL SELECT lower(black_name) FROM pairings) GROUP BY ALL")
def agg04_player_counts(spark, sf_dir):
    p = view(spark, sf_dir, "pairings")
    return p.select(F.explode(F.array(person_key(F.col("white_name")), person_key(F.col("black_name")))).alias("player")).groupBy("player").agg(F.count("*").alias("games"))


@query("WITH g AS (SELECT game_id, max(status) AS status FROM fixes GROUP BY ALL) SELECT count(*) AS total, count_if(status = 'VALID')::BIGINT AS verified, count_if(status <> 'PARTIAL')::BIGINT AS read, count_if(status = 'PARTIAL' AND game_id <> 0)::BIGINT AS actionable FROM g", "fixes")
def agg05_status_totals(spark, sf_dir):
    g = view(spark, sf_dir, "fixes").groupBy("game_id").agg(F.max("status").alias("status"))
    return g.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "VALID").alias("verified"), F.count_if(F.col("status") != "PARTIAL").alias("read"), F.count_if((F.col("status") == "PARTIAL") & (F.col("game_id") != 0)).alias("actionable"))


COMPARE = """pl AS (SELECT *, CASE method WHEN 'dijkstra' THEN 0 WHEN 'beam' THEN 1 ELSE 2 END AS place FROM fixes), one AS (SELECT game_id, method, ply, max(regexp_replace(san, '[+#]$', '')) AS san FROM fixes GROUP BY ALL), ms AS (SELECT game_id, count(DISTINCT method) AS methods, min(place) AS first FROM pl GROUP BY ALL),
pp AS (SELECT game_id, ply, count(*) AS n, count(DISTINCT san) AS d FROM one GROUP BY ALL), cc AS (SELECT game_id, methods, first, count_if(n = methods AND d = 1)::BIGINT AS agreements, count_if(NOT (n = methods AND d = 1))::BIGINT AS disagreements, count(*) AS total FROM pp JOIN ms USING (game_id) GROUP BY ALL),
st AS (SELECT game_id, method, place, max(status) AS status, count(*) AS n FROM pl GROUP BY ALL),
cmp AS (SELECT cc.*, (SELECT min(CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END) FROM pl WHERE pl.game_id = cc.game_id AND pl.place = cc.first) AS min_similarity FROM cc)"""


@query(f"WITH {COMPARE} SELECT game_id, methods, agreements, disagreements, total, round(min_similarity, 6) AS min_similarity FROM cmp", "fixes")
def agg09_compare_methods(spark, sf_dir):
    return V.compare_methods(view(spark, sf_dir, "fixes")).withColumn("min_similarity", F.round("min_similarity", 6))


@query(f"""WITH {COMPARE}, so AS (SELECT game_id, bool_and(status = 'SOLVED') AS solved FROM st GROUP BY ALL) SELECT game_id, CASE WHEN NOT solved THEN 'C' WHEN disagreements = 0 AND total <= 5 AND min_similarity >= 0.7 THEN 'A' WHEN disagreements <= 2 AND total <= 12 THEN 'B' ELSE 'C' END AS tier,
CASE WHEN NOT solved THEN 'not_solved' WHEN disagreements = 0 AND total <= 5 AND min_similarity >= 0.7 THEN 'agreed' WHEN disagreements <= 2 AND total <= 12 THEN 'minor' WHEN disagreements > 2 THEN 'disagree' ELSE 'many_fixes' END AS reason FROM cmp JOIN so USING (game_id)""", "fixes")
def agg10_triage_tier(spark, sf_dir):
    return V.triage(view(spark, sf_dir, "fixes"))


@query(f"WITH {COMPARE} SELECT game_id, method, status FROM st WHERE status IN ('SOLVED', 'VALID', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY status = 'PARTIAL', place) = 1", "fixes")
def agg11_pick_best_method(spark, sf_dir):
    return V.pick_best(view(spark, sf_dir, "fixes"))


@query("""WITH p AS (SELECT * FROM pairings WHERE white_sno <> 0 AND black_sno <> 0), m AS (SELECT section, max(c) AS most FROM (SELECT section, least(white_sno, black_sno) a, greatest(white_sno, black_sno) b, count(*) c FROM p GROUP BY ALL) GROUP BY ALL), k AS (SELECT section, count(DISTINCT x) AS players FROM (SELECT section, unnest([white_sno, black_sno]) AS x FROM p) GROUP BY ALL), r AS (SELECT section, count(DISTINCT round) AS rounds FROM pairings GROUP BY ALL)
SELECT section, players, rounds, CASE WHEN most = 1 AND rounds IN (players, players - 1) THEN 'round robin' ELSE 'swiss' END AS event_type FROM r LEFT JOIN k USING (section) LEFT JOIN m USING (section)""")
def agg12_event_type(spark, sf_dir):
    return L.event_types(view(spark, sf_dir, "pairings"))


@query("SELECT section, count(DISTINCT round) AS rounds, count(DISTINCT white_name) AS players FROM pairings GROUP BY ALL ORDER BY rounds DESC, players DESC, section LIMIT 1")
def agg13_richest_source(spark, sf_dir):
    p = view(spark, sf_dir, "pairings").groupBy("section").agg(F.count_distinct("round").alias("rounds"), F.count_distinct("white_name").alias("players"))
    return p.orderBy(F.desc("rounds"), F.desc("players"), "section").limit(1)


ASPECTS = "CASE sheet_id % 3 WHEN 0 THEN 0.71::DOUBLE WHEN 1 THEN 0.74::DOUBLE ELSE 1.48::DOUBLE END"
COLUMNS = """j AS (SELECT sheet_id, x_frac, coalesce((x_frac - lag(x_frac) OVER (PARTITION BY sheet_id ORDER BY x_frac) > 0.025)::INT, 0) AS j FROM uneven), k AS (SELECT *, sum(j) OVER (PARTITION BY sheet_id ORDER BY x_frac) AS c FROM j),
cl AS (SELECT sheet_id, c, median(x_frac) AS centre FROM k GROUP BY ALL HAVING count(*) >= 4), pl AS (SELECT sheet_id, centre, row_number() OVER (PARTITION BY sheet_id ORDER BY centre) AS place, count(*) OVER (PARTITION BY sheet_id) AS n FROM cl QUALIFY n >= 2)"""


def uneven(spark, sf_dir) -> DataFrame:
    """Boxes of which every eleventh sheet lacks a column or more."""
    return view(spark, sf_dir, "boxes").where("sheet_id % 11 <> 0 or col_hint <= sheet_id % 4 + 1")


@query(f"""WITH uneven AS (SELECT * FROM boxes WHERE sheet_id % 11 <> 0 OR col_hint <= sheet_id % 4 + 1), {COLUMNS},
l AS (SELECT sheet_id, sheet_id % 10 AS layout, CAST(floor({ASPECTS} / 0.1 + 0.5) AS BIGINT) AS bucket, n FROM (SELECT DISTINCT sheet_id, n FROM pl) QUALIFY row_number() OVER (PARTITION BY layout, bucket ORDER BY sheet_id DESC) <= 15),
m AS (SELECT layout, bucket, n, count(*) AS k, sum(count(*)) OVER (PARTITION BY layout, bucket) AS every FROM l GROUP BY layout, bucket, n QUALIFY row_number() OVER (PARTITION BY layout, bucket ORDER BY count(*) DESC, n) = 1)
SELECT layout, bucket, place, round(median(centre), 6) AS x FROM l JOIN (SELECT * FROM m WHERE k >= 3 AND every >= 3) USING (layout, bucket, n) JOIN pl USING (sheet_id) GROUP BY ALL""", "boxes")
def agg14_grid_consensus(spark, sf_dir):
    b = uneven(spark, sf_dir)
    aspect = F.when(F.col("sheet_id") % 3 == 0, 0.71).when(F.col("sheet_id") % 3 == 1, 0.74).otherwise(1.48)
    sheets = b.select("sheet_id").distinct().select("sheet_id", (F.col("sheet_id") % 10).alias("layout"), aspect.alias("aspect"), F.col("sheet_id").alias("taken"))
    return V.grid_consensus(b, sheets).select("layout", "bucket", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("""WITH y AS (SELECT sheet_id, floor(y_frac * 20) * 50 + (y_frac * 60) % 7 + CASE WHEN sheet_id % 6 = 1 THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM boxes WHERE sheet_id % 8 <> 3 OR y_frac < 0.6), j AS (SELECT *, coalesce((y - lag(y) OVER (PARTITION BY sheet_id ORDER BY y) > 10)::INT, 0) AS j FROM y), k AS (SELECT *, sum(j) OVER (PARTITION BY sheet_id ORDER BY y) AS c FROM j),
cl AS (SELECT sheet_id, avg(y) AS y FROM k GROUP BY sheet_id, c), r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY y) AS i, count(*) OVER (PARTITION BY sheet_id) AS n FROM cl),
p AS (SELECT a.sheet_id AS left_id, b.sheet_id AS right_id, abs(any_value(a.n) - any_value(b.n)) AS row_difference, round(avg(abs(a.y - b.y)), 6) AS deviation FROM r a JOIN r b ON b.sheet_id = a.sheet_id + 1 AND a.i = b.i WHERE a.sheet_id % 2 = 0 GROUP BY ALL)
SELECT *, row_difference <= 2 AND deviation < 15 AS aligned, round(CASE WHEN row_difference <= 2 THEN greatest(0, 1 - deviation / 50) ELSE 0.3::DOUBLE END, 5) AS confidence FROM p""", "boxes")
def agg15_row_alignment(spark, sf_dir):
    """Rows of 50 pixels with some noise; some right sheets lie lower, some lack their last rows."""
    b = view(spark, sf_dir, "boxes").where("sheet_id % 8 <> 3 or y_frac < 0.6")
    y = F.floor(F.col("y_frac") * 20) * 50 + (F.col("y_frac") * 60) % 7 + F.when(F.col("sheet_id") % 6 == 1, 14.0).otherwise(0.0)
    cells = b.select("sheet_id", y.alias("y"))
    pairs = b.where("sheet_id % 2 = 0").select(F.col("sheet_id").alias("left_id"), (F.col("sheet_id") + 1).alias("right_id")).distinct()
    found = V.row_alignment(cells, pairs).withColumn("deviation", F.round("deviation", 6))
    return found.withColumn("confidence", F.round("confidence", 5))


REPORT = """d AS (SELECT game_id, count_if(action = 'override')::BIGINT AS user_overrides, count_if(action = 'confirm')::BIGINT AS confirmations, count_if(action = 'keep')::BIGINT AS keeps, count_if(action = 'edit')::BIGINT AS review_edits, count(DISTINCT event_id % 37) AS surfaced_decisions, CAST(round(sum(t_sec)) AS BIGINT) AS review_seconds, count(DISTINCT event_id % 3) AS review_sessions FROM decisions GROUP BY ALL),
best AS (SELECT game_id, method FROM st WHERE status IN ('SOLVED', 'VALID', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY status = 'PARTIAL', place) = 1),
pk AS (SELECT game_id, max(ply) AS plies, count(*) AS algorithm_fixes FROM fixes JOIN best USING (game_id, method) GROUP BY ALL), so AS (SELECT game_id, bool_and(status = 'SOLVED') AS solved FROM st GROUP BY ALL),
tr AS (SELECT game_id, CASE WHEN NOT solved THEN 'C' WHEN disagreements = 0 AND total <= 5 AND min_similarity >= 0.7 THEN 'A' WHEN disagreements <= 2 AND total <= 12 THEN 'B' ELSE 'C' END AS tier, CASE WHEN NOT solved THEN 'not_solved' WHEN disagreements = 0 AND total <= 5 AND min_similarity >= 0.7 THEN 'agreed' WHEN disagreements <= 2 AND total <= 12 THEN 'minor' WHEN disagreements > 2 THEN 'disagree' ELSE 'many_fixes' END AS reason FROM cmp JOIN so USING (game_id)),
gap AS (SELECT game_id, (epoch_us(lead(ts) OVER (PARTITION BY game_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM (SELECT user_id AS game_id, ts, event_id FROM events)), att AS (SELECT game_id, CAST(round(sum(gap)) AS BIGINT) AS attention_seconds FROM gap WHERE gap > 0 AND gap <= 7200 GROUP BY ALL),
ga AS (SELECT pairing_id AS game_id, section, round, board, pairing_id % 90 AS cells, CASE WHEN pairing_id % 3 = 0 THEN pairing_id % 80 END AS final_plies, CASE WHEN pairing_id % 4 <> 0 THEN 'verified' END AS status FROM pairings)"""


@query(f"""WITH {COMPARE}, {REPORT} SELECT game_id, coalesce(section, '') AS section, round, board, coalesce(p.white_name, '') AS white, coalesce(p.black_name, '') AS black, coalesce(p.result_raw, '') AS result, coalesce(nullif(final_plies, 0), plies, 0) AS total_moves, coalesce(cells, 0) AS ocr_cells, coalesce(algorithm_fixes, 0) AS algorithm_fixes,
coalesce(user_overrides, 0) AS user_overrides, coalesce(confirmations, 0) AS confirmations, coalesce(keeps, 0) AS keeps, coalesce(review_edits, 0) AS review_edits, coalesce(surfaced_decisions, 0) AS surfaced_decisions, coalesce(review_seconds, 0) AS review_seconds, coalesce(attention_seconds, 0) AS attention_seconds, coalesce(review_sessions, 0) AS review_sessions, coalesce(tier, '') AS tier, coalesce(reason, '') AS triage_reason, coalesce(status, '') AS status
FROM ga LEFT JOIN (SELECT pairing_id AS game_id, white_name, black_name, result_raw FROM pairings WHERE board IS NOT NULL) p USING (game_id) LEFT JOIN pk USING (game_id) LEFT JOIN d USING (game_id) LEFT JOIN att USING (game_id) LEFT JOIN tr USING (game_id)""", "decisions pairings fixes")
def agg16_game_report(spark, sf_dir):
    p, k = view(spark, sf_dir, "pairings"), F.col("pairing_id")
    games = p.select(k.alias("game_id"), "section", "round", "board", (k % 90).alias("cells"), F.when(k % 3 == 0, k % 80).alias("final_plies"), F.when(k % 4 != 0, "verified").alias("status"))
    names = p.where("board is not null").select(k.alias("game_id"), "white_name", "black_name", F.col("result_raw").alias("result"))
    decisions = view(spark, sf_dir, "decisions").withColumns({"ply": F.col("event_id") % 37, "session": F.col("event_id") % 3})
    open_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("operator_id"), F.col("user_id").alias("open_game"), "ts", "event_id")
    seconds = attention(open_, 7200).withColumnRenamed("open_game", "game_id")
    return V.game_report(games, decisions, view(spark, sf_dir, "fixes"), names, seconds)


@query("SELECT ocr, " + ", ".join(f"count_if(final_san = '{p}')::BIGINT AS \"{p}\"" for p in "KQRBN") + " FROM decisions GROUP BY ALL", "decisions")
def agg17_decision_confusion(spark, sf_dir):
    return V.confusion(view(spark, sf_dir, "decisions"), tuple("KQRBN"))


@query("SELECT action, round(quantile_cont(t_sec, 0.5), 6) AS p50, round(quantile_cont(t_sec, 0.9), 6) AS p90, count(*) AS n FROM decisions GROUP BY ALL", "decisions")
def agg17_decision_latency(spark, sf_dir):
    found = V.latency(view(spark, sf_dir, "decisions"))
    return found.withColumns({q: F.round(q, 6) for q in ("p50", "p90")})


@query("""WITH g AS (SELECT game_id, min(event_id) % 9 + 1 AS round, CASE WHEN game_id % 4 <> 0 THEN min(event_id) % 30 + 1 END AS board FROM decisions WHERE game_id % 7 <> 2 GROUP BY game_id),
d AS (SELECT game_id, event_id, CASE WHEN event_id % 6 <> 5 THEN event_id % 90 END AS ply, action, ocr, CASE WHEN event_id % 3 = 0 THEN ocr || 'f3' END AS proposed, final_san, CASE event_id % 4 WHEN 0 THEN 'beam' WHEN 1 THEN 'greedy' END AS method, 's' || event_id % 5 AS session, t_sec FROM decisions)
SELECT game_id, round, board, ply, CASE WHEN ply IS NULL THEN '' ELSE (ply // 2 + 1) || CASE WHEN ply % 2 = 0 THEN '.W' ELSE '.B' END END AS move, action, ocr, coalesce(proposed, '') AS proposed, final_san, coalesce(method, '') AS method, session, t_sec FROM d JOIN g USING (game_id)""", "decisions")
def agg17_decision_log(spark, sf_dir):
    """Every action with its game's round and board; some have no ply, proposal or method, some games are unknown."""
    d, k = view(spark, sf_dir, "decisions"), F.col("event_id")
    games = d.where("game_id % 7 <> 2").groupBy("game_id").agg(F.min("event_id").alias("e")).select("game_id", (F.col("e") % 9 + 1).alias("round"), F.when(F.col("game_id") % 4 != 0, F.col("e") % 30 + 1).alias("board"))
    more = {"ply": F.when(k % 6 != 5, k % 90), "proposed": F.when(k % 3 == 0, F.concat("ocr", F.lit("f3"))), "method": F.when(k % 4 == 0, "beam").when(k % 4 == 1, "greedy"), "session": F.concat(F.lit("s"), (k % 5).cast("string"))}
    return V.decision_log(games, d.withColumns(more))


@query("WITH a AS (SELECT file_id, path, size_bytes, modified_at FROM files QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY file_id) = 1) SELECT file_id FROM a QUALIFY row_number() OVER (PARTITION BY lower(split_part(path, '/', -1)), size_bytes, modified_at ORDER BY file_id) = 1", "files")
def agg20_dedupe_files(spark, sf_dir):
    return L.dedupe_files(view(spark, sf_dir, "files")).select("file_id")


@query("""WITH t AS (SELECT file_id, split_part(path, '/', -1) AS name, file_id % 4 AS k, file_id % 9 + 1 AS round, file_id // 72 + 1 AS board, CASE file_id % 4 WHEN 0 THEN file_id % 3 + 1 WHEN 1 THEN 1 ELSE 2 END AS page FROM files WHERE file_id % 4 < 3),
s AS (SELECT *, CASE k WHEN 0 THEN 'Open' WHEN 1 THEN 'U1300' ELSE 'Open' END AS section FROM t) SELECT section || '_R' || round || '_B' || board AS game_id, count(*) AS n, string_agg(file_id::VARCHAR, ',' ORDER BY page, name, file_id) AS pages FROM s GROUP BY ALL""", "files")
def agg21_group_files_into_games(spark, sf_dir):
    g = L.group_files(view(spark, sf_dir, "files"))
    return g.select("game_id", F.size("pages").cast("long").alias("n"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT game_id, seq, CAST(row_number() OVER (PARTITION BY game_id ORDER BY seq) - 1 AS BIGINT) AS i, (row_number() OVER (PARTITION BY game_id ORDER BY seq) - 1) // 2 + 1 AS num, CASE WHEN (row_number() OVER (PARTITION BY game_id ORDER BY seq) - 1) % 2 = 0 THEN 'w' ELSE 'b' END AS color FROM edits WHERE op = 'insert'", "edits")
def win13_renumber(spark, sf_dir):
    return V.renumbered(view(spark, sf_dir, "edits").where("op = 'insert'"), ["game_id"], ["seq"]).select("game_id", "seq", "i", "num", "color")


PLIES = "locked AS (SELECT user_id AS game_id, list(DISTINCT event_id % 25 ORDER BY event_id % 25) AS plies, count(*) % 20 AS frontier FROM events GROUP BY ALL)"


@query(f"""WITH {PLIES} SELECT game_id, seq, array_to_string(CASE op WHEN 'delete' THEN list_transform(list_filter(plies, lambda p: p <> pos), lambda p: CASE WHEN p > pos THEN p - 1 ELSE p END) ELSE list_transform(plies, lambda p: CASE WHEN p >= pos THEN p + 1 ELSE p END) END, ',') AS plies,
CASE WHEN frontier <= 0 THEN frontier WHEN op = 'delete' AND frontier > pos THEN frontier - 1 WHEN op = 'insert' AND frontier >= pos THEN frontier + 1 ELSE frontier END AS frontier FROM edits JOIN locked USING (game_id)""", "edits")
def win13_shift_plies(spark, sf_dir):
    """Each edit's effect on its game's list of locked plies and on its frontier."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("game_id")).agg(F.array_sort(F.collect_set(F.col("event_id") % 25)).alias("plies"), (F.count("*") % 20).alias("frontier"))
    j = view(spark, sf_dir, "edits").join(e, "game_id")
    plies, frontier = V.shifted_plies(F.col("plies"), F.col("pos"), F.col("op")), V.shifted_frontier(F.col("frontier"), F.col("pos"), F.col("op"))
    return j.select("game_id", "seq", F.concat_ws(",", F.transform(plies, lambda p: p.cast("string"))).alias("plies"), frontier.alias("frontier"))


def board_list(spark, sf_dir) -> DataFrame:
    """Games with their state of review: verified, noisy, and how far a search has come."""
    k = F.col("pairing_id")
    state = {"review": (k % 3 == 0).cast("int"), "search": F.when(k % 5 < 2, 0).otherwise(k % 5 - 1).cast("int"), "list": F.when(k % 3 == 0, 2).when(k % 7 == 1, 0).otherwise(1)}
    return view(spark, sf_dir, "pairings").withColumns(state).withColumn("round", F.when(k % 13 != 0, F.col("round"))).withColumnRenamed("pairing_id", "game_id")


BOARDS = "g AS (SELECT pairing_id AS game_id, section, board, CASE WHEN pairing_id % 13 <> 0 THEN round END AS round, (pairing_id % 3 = 0)::INT AS review, CASE WHEN pairing_id % 5 < 2 THEN 0 ELSE pairing_id % 5 - 1 END AS search, CASE WHEN pairing_id % 3 = 0 THEN 2 WHEN pairing_id % 7 = 1 THEN 0 ELSE 1 END AS list FROM pairings)"


@query(f"WITH {BOARDS} SELECT game_id, row_number() OVER (PARTITION BY section ORDER BY review, search, round NULLS LAST, board NULLS LAST, game_id) AS place FROM g")
def win15_work_order(spark, sf_dir):
    return V.work_order(board_list(spark, sf_dir), ["section"], ["review", "search", F.asc_nulls_last("round"), F.asc_nulls_last("board"), "game_id"]).select("game_id", "place")


@query(f"WITH {BOARDS} SELECT game_id, row_number() OVER (PARTITION BY section, round ORDER BY list, board NULLS LAST, game_id) AS place FROM g")
def win15_board_list(spark, sf_dir):
    return V.work_order(board_list(spark, sf_dir), ["section", "round"], ["list", F.asc_nulls_last("board"), "game_id"]).select("game_id", "place")


@query(f"""WITH {BOARDS}, o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY section, round, board % 50) AS n FROM g WINDOW w AS (PARTITION BY section, round, board % 50 ORDER BY board NULLS LAST, game_id)),
j AS (SELECT a.game_id, b.game_id AS other, (b.i - a.i - 1 + a.n) % a.n AS d FROM o a JOIN o b ON a.section = b.section AND a.round IS NOT DISTINCT FROM b.round AND (a.board % 50) IS NOT DISTINCT FROM (b.board % 50) AND a.game_id <> b.game_id AND b.review = 0)
SELECT g.game_id, arg_min(other, d) AS next_id FROM g LEFT JOIN j USING (game_id) GROUP BY ALL""")
def win15_next_item(spark, sf_dir):
    b = board_list(spark, sf_dir).withColumn("hall", F.col("board") % 50)
    return V.next_item(b, ["section", "round", "hall"], [F.asc_nulls_last("board"), "game_id"], F.col("review") == 0).select("game_id", "next_id")


@query("SELECT section, count(*) AS n, count_if(section IN ('S0', 'S1') AND length(result_raw) > 0)::BIGINT AS with_result, strftime(min(played_at), '%Y.%m.%d') AS starts, strftime(max(played_at), '%Y.%m.%d') AS ends FROM pairings GROUP BY ALL", "pairings")
def set01_union_parts(spark, sf_dir):
    """All sections, half of them from a source without results."""
    p = view(spark, sf_dir, "pairings")
    both = L.union_parts([p.where("section in ('S0', 'S1')"), p.where("section not in ('S0', 'S1')").drop("result_raw")])
    day = lambda f: F.date_format(f("played_at"), "yyyy.MM.dd")
    return both.groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.length("result_raw") > 0).alias("with_result"), day(F.min).alias("starts"), day(F.max).alias("ends"))


@query("""WITH h AS (SELECT board % 20 AS event_id, round AS part, section, CASE WHEN pairing_id % 3 = 0 THEN 'E' || pairing_id ELSE '' END AS event, CASE WHEN pairing_id % 5 = 0 THEN 'City ' || section END AS site, played_at FROM pairings WHERE board IS NOT NULL QUALIFY row_number() OVER (PARTITION BY board % 20, round, section ORDER BY pairing_id) = 1)
SELECT event_id, coalesce(arg_min(event, (part, section)) FILTER (event <> ''), '') AS event, coalesce(arg_min(site, (part, section)) FILTER (site <> ''), '') AS site, strftime(min(played_at), '%Y.%m.%d') AS starts, strftime(max(played_at), '%Y.%m.%d') AS ends, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM h GROUP BY event_id""", "pairings")
def set01_union_headers(spark, sf_dir):
    """Parts of one event: rounds and sections, of which some name it, its place, or neither."""
    k, key = F.col("pairing_id"), (F.col("board") % 20).alias("event_id")
    first = view(spark, sf_dir, "pairings").where("board is not null").groupBy(key, F.col("round").alias("part"), "section").agg(F.min_by(F.struct("pairing_id", "played_at"), "pairing_id").alias("p")).select("event_id", "part", "section", "p.*")
    day = F.date_format("played_at", "yyyy.MM.dd")
    heads = first.select("event_id", "part", "section", F.when(k % 3 == 0, F.concat(F.lit("E"), k.cast("string"))).otherwise("").alias("event"), F.when(k % 5 == 0, F.concat(F.lit("City "), F.col("section"))).alias("site"), day.alias("starts"), day.alias("ends"))
    return L.union_headers(heads, ["event_id"], ["part", "section"]).withColumn("sections", F.array_join("sections", ","))


SIM = "CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END"


FIX = ["game_id", "method", "ply", "san"]


def with_components(spark, sf_dir) -> DataFrame:
    """Fixes of each game, method, ply and move, with what a search would know of them."""
    f, ply = view(spark, sf_dir, "fixes"), F.col("ply")
    sim = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    best = f.groupBy(*FIX).agg(F.max(sim).alias("similarity"))
    known = {"stuck_ply": F.lit(8), "reach": (ply * 3 + F.length("san")) % 12 - 2, "completes": ply % 5 == 0, "low_conf": ply % 4 == 1, "conf": (ply % 10).cast("double") / 10, "lenient": F.when(ply % 6 == 0, 20).when(ply % 6 == 3, 10).otherwise(0), "pattern": (ply * 7) % 31, "root_duplicate": ply % 9 == 0, "duplicate": ply % 9 == 4, "ambiguous": F.col("san").contains("+"), "absurdity": ply % 3, "future_capture": ply % 4, "hanging": F.when(ply % 2 == 1, 3)}
    return E.components(best.withColumns(known))


SCORED = f"""b AS (SELECT game_id, method, ply, san, max({SIM}) AS sim, (ply * 3 + length(san)) % 12 - 2 AS reach FROM fixes GROUP BY ALL), sc AS (SELECT game_id, method, ply, san, sim,
40 * sim + 15 * ((ply % 10)::DOUBLE / 10) + CASE WHEN ply % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN ply % 4 = 1 AND ply % 10 > 0 THEN 10 ELSE 0 END + CASE WHEN contains(san, '+') THEN 10 ELSE 0 END + least(reach * 10, 50) + CASE WHEN ply >= 8 OR ply % 5 = 0 THEN greatest(reach - 5, 0) ELSE 0 END
+ CASE ply % 6 WHEN 0 THEN 20 WHEN 3 THEN 10 ELSE 0 END + least(ply * 7 % 31, 30) + CASE WHEN ply % 9 = 0 AND ply <> 8 THEN 25 WHEN ply % 9 IN (0, 4) THEN 15 ELSE 0 END - CASE WHEN reach > 0 THEN 0 WHEN sim >= 0.95 THEN 5 WHEN sim >= 0.9 THEN 15 WHEN sim >= 0.8 THEN 25 WHEN sim >= 0.7 THEN 32 ELSE 40 END
- CASE WHEN reach <= 0 AND ply <> 8 THEN least((8 - ply) * 5, 30) ELSE 0 END + CASE WHEN reach > 0 AND ply = 8 THEN 15 ELSE 0 END - ply % 3 + ply % 4 - 3 * (ply % 2) AS score FROM b)"""


@query(f"WITH {SCORED} SELECT game_id, method, ply, san, round(score, 6) AS score, rank() OVER (PARTITION BY game_id, method ORDER BY round(score, 9) DESC) AS place FROM sc", "fixes")
def rnk04_additive_score(spark, sf_dir):
    scores = E.weighted(with_components(spark, sf_dir), C.SCORE_WEIGHTS, FIX)
    return E.ranked_fixes(scores, ["game_id", "method"]).withColumns({"score": F.round("score", 6), "place": F.col("place").cast("long")})


PRIOR = "CASE WHEN ply % 4 = 0 THEN ln((ply % 7 + 1)::DOUBLE / 10) END"


@query(f"WITH {SCORED}, e AS (SELECT *, CASE WHEN ply % 3 = 0 THEN -10.0::DOUBLE * sim END AS ctc, {PRIOR} AS prior FROM sc), r AS (SELECT game_id, method, ply, san, round(score + 3.0::DOUBLE * (coalesce(ctc, -19.27::DOUBLE) + 19.27::DOUBLE) + 10.0::DOUBLE * (coalesce(prior, ln(1e-4::DOUBLE)) - ln(1e-4::DOUBLE)), 6) AS score FROM e) SELECT *, row_number() OVER (PARTITION BY game_id, method ORDER BY score DESC, ply, san) AS place FROM r", "fixes")
def rnk05_evidence_rescore(spark, sf_dir):
    f = with_components(spark, sf_dir)
    ctc = f.where("ply % 3 = 0").select(*FIX, (-10.0 * F.col("similarity")).alias("value"))
    prior = f.where("ply % 4 = 0").select(*FIX, F.log((F.col("ply") % 7 + 1) / 10).alias("value"))
    s = E.rescore(E.weighted(f, C.SCORE_WEIGHTS, FIX), ctc, FIX, C.CTC_WEIGHT, C.CTC_ABSTAIN)
    s = E.rescore(s, prior, FIX, C.PRIOR_WEIGHT, math.log(1e-4)).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("game_id", "method").orderBy(F.desc("score"), "ply", "san")
    return s.withColumn("place", F.row_number().over(order).cast("long"))


TRIED = (0.0, 1.0, 3.0, 10.0, 30.0)


def decisions_of(spark, sf_dir) -> DataFrame:
    """Candidates of each decision (a game's ply), with a score, an evidence value and whether they are right."""
    f = with_components(spark, sf_dir)
    s = E.weighted(f, C.SCORE_WEIGHTS, FIX).groupBy("game_id", "ply", "san").agg(F.max("score").alias("score"))
    value = F.log((F.length("san") * 5 + F.col("ply") * F.ascii("san")) % 9 + 1) - F.log(F.lit(10.0))
    truth = F.col("san") == F.min("san").over(Window.partitionBy("game_id", "ply"))
    return s.select(F.col("game_id").alias("group"), F.col("ply").alias("decision"), F.col("san").alias("text"), "score", value.alias("value"), truth.alias("correct"))


DECIDED = f"""{SCORED}, s1 AS (SELECT game_id, ply, san, max(score) AS score FROM sc GROUP BY ALL), cd AS (SELECT game_id AS g, ply AS d, san AS t, score, ln((length(san) * 5 + ply * ascii(san)) % 9 + 1) - ln(10.0::DOUBLE) AS v, (san = min(san) OVER (PARTITION BY game_id, ply))::INT AS ok FROM s1),
tw AS (SELECT *, unnest([0.0, 1.0, 3.0, 10.0, 30.0]::DOUBLE[]) AS w FROM cd), fp AS (SELECT g, d, w, ok FROM tw QUALIFY row_number() OVER (PARTITION BY g, d, w ORDER BY round(score + w * v, 9) DESC, t) = 1), hw AS (SELECT g, w, count(*) AS n, sum(ok)::BIGINT AS hits FROM fp GROUP BY ALL)"""


@query(f"""WITH {DECIDED}, pr AS (SELECT g, d, max(ok) FILTER (w = 0) AS a, max(ok) FILTER (w = 10) AS b FROM fp GROUP BY ALL), c AS (SELECT count(*) AS decisions, sum(a)::BIGINT AS a_hits, sum(b)::BIGINT AS b_hits, count_if(b > a)::BIGINT AS wins, count_if(a > b)::BIGINT AS losses FROM pr)
SELECT *, round(least(1, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))) FROM (SELECT unnest(range(0, (SELECT least(wins, losses) + 1 FROM c))) AS k))), 6) AS p FROM c""", "fixes")
def rnk09_ranking_evaluation(spark, sf_dir):
    """Rank-1 hits without and with the evidence over the same decisions, with a sign test."""
    return E.paired(decisions_of(spark, sf_dir), 0.0, C.PRIOR_WEIGHT).withColumn("p", F.round("p", 6))


@query(f"WITH {DECIDED} SELECT w AS weight, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits, round(sum(hits)::DOUBLE / sum(n), 6) AS rate FROM hw GROUP BY ALL", "fixes")
def rnk09_accuracy_by_weight(spark, sf_dir):
    h = E.hits_by_weight(decisions_of(spark, sf_dir), TRIED)
    return h.groupBy("weight").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 6).alias("rate"))


@query(f'WITH {DECIDED}, r AS (SELECT *, sum(hits) OVER (PARTITION BY w) - hits AS rest FROM hw) SELECT g AS "group", w AS weight, n, hits FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY rest DESC, w) = 1', "fixes")
def rnk09_leave_one_out(spark, sf_dir):
    return E.leave_one_out(E.hits_by_weight(decisions_of(spark, sf_dir), TRIED))


@query(f"""WITH {DECIDED}, nt AS (SELECT g, sum(CASE w WHEN 10 THEN hits WHEN 0 THEN -hits ELSE 0 END) AS net FROM hw GROUP BY ALL), dr AS (SELECT net, b, ((g * 7919 + b * 104729 + 12345) * 2654435761 % 4294967296)::DOUBLE / 4294967296 AS u FROM nt, (SELECT unnest(range(0, 200)) AS b)),
x AS (SELECT b, sum(net * ({" + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in E.POISSON)})) AS x FROM dr GROUP BY ALL)
SELECT round(quantile_cont(x::DOUBLE, 0.025), 6) AS low, round(quantile_cont(x::DOUBLE, 0.975), 6) AS high, (SELECT sum(net)::BIGINT FROM nt) AS net FROM x""", "fixes")
def rnk09_bootstrap(spark, sf_dir):
    found = E.bootstrap(E.hits_by_weight(decisions_of(spark, sf_dir), TRIED), 0.0, C.PRIOR_WEIGHT)
    return found.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "net")


@query(f"WITH b AS (SELECT game_id, ply, san, method, max({SIM}) AS score FROM fixes GROUP BY ALL), m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY game_id, ply, san ORDER BY score DESC, method) = 1) SELECT game_id, ply, san, method, round(score, 6) AS score, count(*) OVER (PARTITION BY game_id) AS total FROM m QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY score DESC, ply, san) <= 20", "fixes")
def rnk10_merge_ranked_lists(spark, sf_dir):
    f = view(spark, sf_dir, "fixes")
    sim = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    b = f.groupBy("game_id", "ply", "san", "method").agg(F.max(sim).alias("score"))
    m = b.withColumn("k", F.row_number().over(Window.partitionBy("game_id", "ply", "san").orderBy(F.desc("score"), "method"))).where("k = 1")
    m = m.withColumns({"total": F.count("*").over(Window.partitionBy("game_id")), "k": F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("score"), "ply", "san"))})
    return m.where("k <= 20").select("game_id", "ply", "san", "method", F.round("score", 6).alias("score"), "total")


@query("""WITH g AS (SELECT file_id, section, round, CASE WHEN file_id % 8 <> 3 THEN board END AS board, CASE WHEN file_id % 5 <> 0 THEN file_id END AS pairing_id, 'P' || file_id % 3 AS profile FROM (SELECT file_id, 'S' || file_id % 6 AS section, CASE WHEN file_id % 7 <> 2 THEN file_id % 9 + 1 END AS round, file_id // 40 + 1 AS board FROM files)),
t AS (SELECT 'S' || k AS section, CASE WHEN k <> 2 THEN 'Open ' || k END AS event, CASE WHEN k = 1 THEN 'Town' END AS site, CASE WHEN k <> 3 THEN '2024.05.0' || (k + 1) END AS start_date, CASE WHEN k = 1 THEN 'CAN' END AS country, CASE WHEN k = 2 THEN 'swiss' END AS event_type, k * 3 AS rounds FROM range(0, 4) t(k)),
f AS (SELECT 'P' || k AS profile, CASE WHEN k = 1 THEN 'Hall' END AS site, CASE WHEN k <> 2 THEN 'USA' END AS country FROM range(0, 3) t(k)),
p AS (SELECT pairing_id, white_name, black_name, replace(replace(result_raw, ' ', ''), '½-½', '1/2-1/2') AS result, CASE WHEN pairing_id % 4 = 1 THEN strftime(played_at, '%Y.%m.%d') END AS date, white_rtg, black_rtg, CASE WHEN pairing_id % 6 = 1 THEN 'FM' ELSE '' END AS white_title, pairing_id * 10 AS white_fide_id FROM pairings),
j AS (SELECT g.*, p.*, t.*, f.site AS fsite, f.country AS fcountry, t.section IS NOT NULL AS known FROM g LEFT JOIN p ON g.pairing_id = p.pairing_id LEFT JOIN t ON g.section = t.section LEFT JOIN f ON g.profile = f.profile),
tags AS (SELECT file_id AS game_id, unnest([{'k': 'Event', 'v': CASE WHEN file_id % 12 = 4 THEN 'Mine' ELSE coalesce(event, 'Tournament') END}, {'k': 'Site', 'v': coalesce(site, fsite, '?')}, {'k': 'Date', 'v': coalesce(date, start_date, '????.??.??')},
  {'k': 'Round', 'v': CASE WHEN round IS NULL AND board IS NULL THEN '?' WHEN board IS NULL THEN round::VARCHAR ELSE coalesce(round::VARCHAR, '?') || '.' || board END}, {'k': 'White', 'v': CASE WHEN file_id % 12 = 4 THEN '' ELSE coalesce(white_name, '?') END}, {'k': 'Black', 'v': coalesce(black_name, '?')}, {'k': 'Result', 'v': coalesce(result, '*')}, {'k': 'Section', 'v': section},
  {'k': 'WhiteElo', 'v': nullif(white_rtg, 0)::VARCHAR}, {'k': 'BlackElo', 'v': nullif(black_rtg, 0)::VARCHAR}, {'k': 'WhiteTitle', 'v': nullif(white_title, '')}, {'k': 'WhiteFideId', 'v': nullif(white_fide_id, 0)::VARCHAR},
  {'k': 'EventDate', 'v': start_date}, {'k': 'EventCountry', 'v': coalesce(country, fcountry)}, {'k': 'EventType', 'v': CASE WHEN known THEN coalesce(event_type, 'tourn') END}, {'k': 'EventRounds', 'v': nullif(rounds, 0)::VARCHAR}, {'k': 'ECO', 'v': CASE WHEN file_id % 12 = 4 THEN 'C20' END}]) AS x FROM j)
SELECT game_id, string_agg(x.k || '=' || x.v, ';' ORDER BY x.k) AS headers FROM tags WHERE x.v IS NOT NULL GROUP BY game_id""", "files pairings")
def fn14_build_headers(spark, sf_dir):
    """Games with and without pairing, tournament and profile; some have headers of the caller's own, one of them empty."""
    k = F.col("file_id")
    at = lambda flag, v: F.when(flag, v)
    games = view(spark, sf_dir, "files").select(k.alias("game_id"), F.concat(F.lit("S"), (k % 6).cast("string")).alias("section"), at(k % 7 != 2, k % 9 + 1).alias("round"), at(k % 8 != 3, (F.floor(k / 40) + 1).cast("long")).alias("board"), at(k % 5 != 0, k).alias("pairing_id"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("profile"))
    i = F.col("pairing_id")
    pairings = view(spark, sf_dir, "pairings").select(i, "white_name", "black_name", F.replace(F.replace("result_raw", F.lit(" ")), F.lit("½-½"), F.lit("1/2-1/2")).alias("result"), at(i % 4 == 1, F.date_format("played_at", "yyyy.MM.dd")).alias("date"), "white_rtg", "black_rtg", F.when(i % 6 == 1, "FM").otherwise("").alias("white_title"), (i * 10).alias("white_fide_id"))
    n = F.col("id")
    s = n.cast("string")
    tournaments = spark.range(4).select(F.concat(F.lit("S"), s).alias("section"), at(n != 2, F.concat(F.lit("Open "), s)).alias("event"), at(n == 1, "Town").alias("site"), at(n != 3, F.concat(F.lit("2024.05.0"), (n + 1).cast("string"))).alias("start_date"), at(n == 1, "CAN").alias("country"), at(n == 2, "swiss").alias("event_type"), (n * 3).alias("rounds"))
    profiles = spark.range(3).select(F.concat(F.lit("P"), s).alias("profile"), at(n == 1, "Hall").alias("site"), at(n != 2, "USA").alias("country"))
    overrides = games.where("game_id % 12 = 4").select("game_id", F.create_map(*map(F.lit, ("Event", "Mine", "White", "", "ECO", "C20"))).alias("headers"))
    found = L.build_headers(games, pairings, tournaments, profiles, overrides)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return found.select("game_id", F.array_join(pairs, ";").alias("headers"))
