"""Queries of the column functions: normalise_readings and normalise_inventory, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duoply.fixtures import oracle, view
from duoply.functions import moves as M
from duoply.functions import records as R
from duoply.functions.similarity import ALIKE

def likeness_sql(pairs: str) -> str:
    """SQL tables up to sim(a, b, sim): the structured similarity of the distinct pairs (a, b) of a table."""
    table = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in ALIKE.items()) + "}"
    like = lambda x, y: f"(CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE coalesce(map_extract(al, {x} || {y})[1], map_extract(al, {y} || {x})[1], CASE WHEN lower({x}) = lower({y}) THEN 0.9::DOUBLE END, 0.1::DOUBLE) END)"
    total = lambda x, y: f"coalesce(list_sum([{like(f'({x})[i]', f'({y})[i]')} FOR i IN range(1, least(length({x}), length({y})) + 1)]), 0)"
    side = lambda m, k: f"regexp_extract({m}, '^[KQRBN]') AS g{k}, regexp_extract(replace({m}, 'x', ''), '([a-h][1-8])$', 1) AS s{k}, CASE WHEN length(replace({m}, 'x', '')) >= 4 THEN regexp_extract(replace({m}, 'x', '')[2], '[a-h1-8]') ELSE '' END AS u{k}"
    mark = lambda x, both, lost: f"CASE WHEN NOT contains(a, '{x}') THEN 0 WHEN contains(b, '{x}') THEN {both} ELSE {lost} END"
    origins = f"CASE WHEN ua <> '' AND ub <> '' AND ua <> ub THEN 0.5 + 0.5 * {like('ua', 'ub')} ELSE 1.0::DOUBLE END"
    return f"""l0 AS (SELECT DISTINCT a, b, rtrim(a, '+#') AS o, rtrim(b, '+#') AS c, {table} AS al FROM {pairs}), l1 AS (SELECT *, {side('o', 'a')}, {side('c', 'b')}, replace(upper(o), '0', 'O') AS up, abs(length(o) - length(c)) AS off, greatest(length(o), length(c)) AS most, CASE WHEN length(o) > length(c) THEN o ELSE c END AS lo, CASE WHEN length(o) > length(c) THEN c ELSE o END AS sh FROM l0),
l2 AS (SELECT *, CASE WHEN off >= 2 THEN 0.15::DOUBLE * off ELSE 0 END AS loss, {total('o', 'c')} AS plain FROM l1), l3 AS (SELECT a, b, max({total('(lo[1:k - 1] || lo[k + 1:])', 'sh')}) AS skip FROM (SELECT *, unnest(range(1, most + 1)) AS k FROM l2 WHERE off = 1) GROUP BY ALL),
l4 AS (SELECT l2.*, greatest(plain, coalesce(skip, 0)) / greatest(most, 1) AS ch FROM l2 LEFT JOIN l3 USING (a, b)),
l5 AS (SELECT *, CASE WHEN sa <> '' AND sb <> '' THEN ch * 0.4::DOUBLE + ({like('sa[1]', 'sb[1]')} + {like('sa[2]', 'sb[2]')}) / 2 * 0.6::DOUBLE ELSE ch END AS we, CASE WHEN ga = '' THEN 'P' ELSE ga END AS pa, CASE WHEN gb = '' THEN 'P' ELSE gb END AS pb FROM l4),
l6 AS (SELECT *, CASE WHEN o = c THEN 1.0::DOUBLE WHEN sa <> '' AND sa = sb THEN greatest(0.1::DOUBLE, CASE WHEN ga = gb THEN 0.98::DOUBLE - CASE WHEN ga <> '' AND (ua = '') <> (ub = '') THEN 0.12::DOUBLE ELSE 0 END ELSE CASE WHEN ga <> '' AND gb <> '' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END + 0.15::DOUBLE * {like('pa', 'pb')} END - loss)
WHEN ga = gb AND sa <> '' AND sb <> '' AND sa[1] = sb[1] THEN greatest(0.1::DOUBLE, (0.85::DOUBLE + 0.15::DOUBLE * {like('sa[2]', 'sb[2]')}) * ({origins}) - loss)
WHEN ga = gb AND sa <> '' AND sb <> '' AND sa[2] = sb[2] THEN greatest(0.1::DOUBLE, CASE WHEN ga <> '' AND ua <> '' AND ua = ub THEN 0.8::DOUBLE + 0.2::DOUBLE * {like('sa[1]', 'sb[1]')} ELSE (0.75::DOUBLE + 0.2::DOUBLE * {like('sa[1]', 'sb[1]')}) * CASE WHEN ga <> '' THEN {origins} ELSE 1 END END - loss)
ELSE CASE WHEN ga = gb AND ga <> '' THEN greatest(we, 0.35::DOUBLE) WHEN ga <> gb AND ga <> '' AND gb <> '' THEN we * 0.7::DOUBLE ELSE we END - loss END + {mark('x', 0.08, -0.06)} - CASE WHEN NOT contains(a, 'x') AND contains(b, 'x') THEN 0.03::DOUBLE ELSE 0 END + {mark('+', 0.25, -0.15)} + {mark('#', 0.3, -0.2)} AS moved FROM l5),
sim AS (SELECT a, b, CASE WHEN o = c THEN least(1, greatest(0, moved)) WHEN (up IN ('O-O', 'OO') AND c = 'O-O') OR (up IN ('O-O-O', 'OOO') AND c = 'O-O-O') THEN 1 WHEN contains(up, 'O') OR c IN ('O-O', 'O-O-O') OR o = '' OR c = '' THEN 0.1 ELSE least(0.98::DOUBLE, greatest(0, moved)) END AS sim FROM l6)"""


KEY = ("game_id", "sheet", "ply", "rk")
ID = "game_id, sheet, ply, rk"


def _cells(spark, sf_dir, **columns) -> DataFrame:
    return view(spark, sf_dir, "candidates").select(*KEY, *(c.alias(n) for n, c in columns.items()))


CELLS = ("1-0", "0 - 1", "½-½", "1/2-1/2", "0.5:0.5", "10", "+-", "-+", "==", "00", "11", "5=", "1 0", "½½", "U", "H", "bye z", "zero", "Draw", "", "1-", "abc", "1:0", "=0", "0-0")


def _pairs(spark, sf_dir) -> DataFrame:
    """Tops of both sheets side by side."""
    top = view(spark, sf_dir, "candidates").where("rk = 0")
    a, b = (top.where(F.col("sheet") == s).select("game_id", "ply", F.col("move").alias(f"m{s}"), F.col("conf").alias(f"c{s}")) for s in (1, 2))
    return a.join(b, ["game_id", "ply"])


PAIRS = "WITH pr AS (SELECT a.game_id, a.ply, a.move m1, b.move m2, a.conf c1, b.conf c2 FROM candidates a JOIN candidates b ON a.game_id = b.game_id AND a.ply = b.ply AND a.sheet = 1 AND b.sheet = 2 AND a.rk = 0 AND b.rk = 0)"
NORM = "replace(replace(trim(regexp_replace(coalesce({0}, ''), '[+#]', '', 'g')), '0-0-0', 'O-O-O'), '0-0', 'O-O')"
RX = r"^([KQRBN])?([a-h])?([1-8])?(x)?([a-h])([1-8])(?:=?([QRBN]))?$"
PIECE = f"coalesce(nullif(regexp_extract({NORM}, '{RX}', 1), ''), 'P')"
part = lambda m, i: f"regexp_extract({NORM.format(m)}, '{RX}', {i})"


def fn01_normalize_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, norm=M.normalize_move(F.col("move")))


def fn02_parse_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, p=M.parse_move(F.col("move"))).select(*KEY, "p.piece", "p.target", "p.file", "p.rank", "p.capture", "p.promo")


def fn03_notation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, kind=M.notation_class(F.col("move")))


def fn04_is_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("ply") % 7 == 0, F.substring("move", 1, 1)).otherwise(F.col("move"))
    return _cells(spark, sf_dir, truncated=M.is_truncated(cut))


def fn05_ply_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = M.ply_label(F.col("ply"))
    return _cells(spark, sf_dir, label=label, back=M.label_ply(label))


def fn06_continuous_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "candidates").where("sheet = 1 and rk = 0").select("game_id", F.col("ply").alias("seq"), (F.floor((F.col("ply") % 40) / 2) + 1).cast("long").alias("num"), (F.col("ply") % 2).alias("half"))
    return continuous_ply(cells)


def continuous_ply(cells: DataFrame) -> DataFrame:
    """Where move numbers restart, the largest number of the pages before is added."""
    w = Window.partitionBy("game_id").orderBy("seq")
    paged = cells.withColumn("page", F.sum(F.when(F.col("num") < F.lag("num").over(w), 1).otherwise(0)).over(w))
    most = paged.groupBy("game_id", "page").agg(F.max("num").alias("most"))
    before = most.withColumn("shift", F.coalesce(F.sum("most").over(Window.partitionBy("game_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return paged.join(before, ["game_id", "page"]).select("game_id", "seq", "page", ((F.col("num") + F.col("shift") - 1) * 2 + F.col("half")).alias("ply"))


def fn07_normalize_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four shapes a candidate comes in, as JSON, back to (move, conf)."""
    c = view(spark, sf_dir, "candidates")
    conf = F.format_string("%.2f", "conf")
    shape = F.when(F.col("ply") % 4 == 0, F.concat(F.lit('["'), "move", F.lit('",'), conf, F.lit("]"))).when(F.col("ply") % 4 == 1, F.concat(F.lit('{"move":"'), "move", F.lit('","confidence":'), conf, F.lit("}"))).when(F.col("ply") % 4 == 2, F.concat(F.lit('[["'), "move", F.lit('",'), conf, F.lit("]]"))).otherwise(F.concat(F.lit('"'), "move", F.lit('"')))
    return normalize_candidates(c.select(*KEY, shape.alias("raw")))


def normalize_candidates(raw: DataFrame) -> DataFrame:
    """(keys, move, conf) of a JSON column raw: pair, object, nested pair or text (0.5); a bad confidence is 0.1."""
    v = F.parse_json("raw")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    move = F.coalesce(get("$[0][0]", "string"), F.when(get("$[0][0]", "string").isNull(), get("$[0]", "string")), get("$.move", "string"), get("$", "string"))
    conf = F.coalesce(get("$[0][1]", "double"), get("$[1]", "double"), get("$.confidence", "double"), F.when(F.col("raw").startswith('"'), 0.5), F.lit(0.1))
    return raw.select(*KEY, move.alias("move"), conf.alias("conf"))


def fn08_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("game_id", "ply", F.levenshtein("m1", "m2").cast("long").alias("distance"), F.round(M.disagreement(F.col("m1"), F.col("m2")), 6).alias("strength"))


def fn10_count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("game_id", "ply", M.count_changes(F.col("m1"), F.col("m2")).cast("long").alias("changes"))


def fn11_semantic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("m1"), F.col("m2")
    return _pairs(spark, sf_dir).select("game_id", "ply", F.concat_ws(",", M.semantic_changes(a, b)).alias("reasons"), M.is_safe(a, b).alias("safe"))


def fn12_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, complexity=M.complexity(F.col("move")).cast("long"))


def fn13_result_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairings")
    day = F.date_format("played_at", "yyyy-MM-dd")
    return p.select("pairing_id", R.normalize_result(F.col("result_raw")).alias("result"), R.normalize_date(day).alias("date"))


def round_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result cells in many notations, with a line of text that may hold a date."""
    p, k = view(spark, sf_dir, "pairings"), F.col("pairing_id")
    cell = F.get(F.array(*map(F.lit, CELLS)), (k % len(CELLS)).cast("int"))
    day = F.get(F.array(F.lit(" 2024-May-0"), F.lit(" 2024.05.0"), F.lit(" 2024/05/0"), F.lit(" 2024-05-0"), F.lit("")), (k % 5).cast("int"))
    return p.select("pairing_id", cell.alias("cell"), F.concat(F.lit("Round"), day, (k % 9).cast("string"), F.lit(" hall")).alias("line"))


def fn13_round_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cells(spark, sf_dir).select("pairing_id", R.pair_result(F.col("cell")).alias("result"), R.find_date(F.col("line")).alias("date"))


def fn14_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairings")
    return build_headers(p)


def build_headers(p: DataFrame) -> DataFrame:
    """Header columns of each pairing; defaults where nothing is known, optional tags only when present."""
    word = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    round_tag = F.when(F.col("round").isNull(), F.concat(F.lit("?."), word("board"))).when(F.col("board").isNull(), word("round")).otherwise(F.concat_ws(".", word("round"), word("board")))
    optional = F.map_filter(F.create_map(F.lit("WhiteElo"), F.nullif(F.col("white_rtg"), F.lit(0)), F.lit("BlackElo"), F.nullif(F.col("black_rtg"), F.lit(0))), lambda k, v: v.isNotNull())
    return p.select("pairing_id", F.lit("Tournament").alias("event"), F.coalesce(round_tag, F.lit("?")).alias("round_tag"), F.coalesce(word("white_name"), F.lit("?")).alias("white"), F.coalesce(word("black_name"), F.lit("?")).alias("black"), R.normalize_result(F.col("result_raw")).alias("result"), F.concat_ws(",", F.array_sort(F.map_keys(optional))).alias("optional_tags"), optional["WhiteElo"].alias("white_elo"))


def fn15_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairings")
    return p.select("pairing_id", R.person_key(F.col("white_name")).alias("white_key"), R.pair_key(F.col("white_name"), F.col("black_name")).alias("pair_key"), R.identity(F.col("section"), F.nullif(F.col("white_sno") % 3, F.lit(0)) * F.col("white_sno"), F.col("white_name")).alias("player"))


def fn16_scan_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "files")
    s = R.scan_name(F.element_at(F.split("path", "/"), -1))
    return f.select("file_id", s.alias("s")).select("file_id", "s.section", "s.round", "s.board", "s.page")


def fn17_scan_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "files")
    return f.select("file_id", R.scan_path(F.col("path")).alias("s")).select("file_id", "s.section", "s.round", "s.board", "s.page")


def _layouts(spark, sf_dir) -> DataFrame:
    f = view(spark, sf_dir, "files")
    cached = F.when(F.col("file_id") % 5 == 0, F.lit(None)).when(F.col("file_id") % 3 == 0, F.lit("grid8x2")).otherwise(F.concat(F.lit("grid8x2@"), (F.col("file_id") % 2).cast("string")))
    return f.select("file_id", cached.alias("cached"), F.lit("grid8x2@1").alias("current"))


LAYOUTS = "WITH l AS (SELECT file_id, CASE WHEN file_id % 5 = 0 THEN NULL WHEN file_id % 3 = 0 THEN 'grid8x2' ELSE 'grid8x2@' || CAST(file_id % 2 AS VARCHAR) END AS cached, 'grid8x2@1' AS current FROM files)"


def fn18_layout_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layouts(spark, sf_dir).select("file_id", R.layout_matches(F.col("cached"), F.col("current")).alias("matches"))


def fn19_sheet_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "candidates").where("rk = 0")
    line = F.concat((F.floor(F.col("ply") / 2) + 1).cast("long").cast("string"), F.when(F.col("ply") % 2 == 0, ".W ").otherwise(".B "), F.col("move"))
    sheets = c.withColumn("line", line).groupBy("game_id", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return sheets.select("game_id", "sheet", M.checksum(F.col("lines")).alias("checksum"))


def fn20_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "candidates")
    return c.select(*KEY, F.explode(M.confusable(F.col("move"))).alias("variant"))


def fn21_forced_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.where((F.col("ply") % 6 != 0) & ((M.normalize_move(F.col("m1")) != M.normalize_move(F.col("m2"))) | (F.col("c1") < 0.5))).select("game_id", "ply")


def fn22_filter_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairings")
    mine = F.array(R.identity(F.col("section"), F.col("white_sno"), F.col("white_name")), R.identity(F.col("section"), F.col("black_sno"), F.col("black_name")))
    return p.where((F.col("round").isin(1, 2) & (F.col("section") == "S1")) | F.array_contains(mine, "sno:S2:7")).select("pairing_id", "section", "round")


def fn23_similarity_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("ply") % 10 == 0, "O-O").otherwise(F.col("m1")), F.when(F.col("ply") % 15 == 0, "0-0").otherwise(F.col("m2"))
    return _pairs(spark, sf_dir).select("game_id", "ply", F.round(M.effective_similarity(a, b, F.col("c1")), 6).alias("similarity"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("fn")}

FILE_TOKEN = r"(round|rnd|rd|r|board|bd|b|page|p)[-_ ]*([0-9]+)"
_tok = lambda text, k: f"CAST(nullif(regexp_extract(list_filter(regexp_extract_all(lower({text}), '{FILE_TOKEN}'), lambda t: t[1] = '{k}')[1], '([0-9]+)$', 1), '') AS BIGINT)"
STEM = r"regexp_replace(split_part(path, '/', -1), '\.[A-Za-z0-9]+$', '')"
FOLDERS = "string_split(path, '/')[1:len(string_split(path, '/')) - 1]"

ORACLES = {
    "fn01_normalize_move": oracle("candidates", f"SELECT {ID}, {NORM.format('move')} AS norm FROM candidates"),
    "fn02_parse_move": oracle("candidates", f"SELECT {ID}, {PIECE.format('move')} AS piece, {part('move', 5)} || {part('move', 6)} AS target, {part('move', 5)} AS file, {part('move', 6)} AS rank, {part('move', 4)} = 'x' AS capture, nullif({part('move', 7)}, '') AS promo FROM candidates"),
    "fn03_notation_class": oracle("candidates", f"SELECT {ID}, CASE WHEN regexp_matches(move, '^([KQRBN]x?[a-h][1-8]|([a-h]x)?[a-h][1-8])[+#]?$') THEN 'standard' ELSE 'invalid' END AS kind FROM candidates"),
    "fn04_is_truncated": oracle("candidates", f"SELECT {ID}, NOT regexp_matches({NORM.format('CASE WHEN ply % 7 = 0 THEN move[1] ELSE move END')}, '{RX}') AS truncated FROM candidates"),
    "fn05_ply_math": oracle("candidates", f"SELECT {ID}, CAST(ply // 2 + 1 AS VARCHAR) || CASE WHEN ply % 2 = 0 THEN '.W' ELSE '.B' END AS label, ply AS back FROM candidates"),
    "fn06_continuous_ply": oracle("candidates", "SELECT game_id, ply AS seq, CAST(ply // 40 AS BIGINT) AS page, CAST(ply AS BIGINT) AS ply FROM candidates WHERE sheet = 1 AND rk = 0"),
    "fn07_normalize_candidate": oracle("candidates", f"SELECT {ID}, move, CASE WHEN ply % 4 = 3 THEN 0.5::DOUBLE ELSE CAST(printf('%.2f', conf) AS DOUBLE) END AS conf FROM candidates"),
    "fn08_edit_distance": oracle("candidates", f"{PAIRS}, n AS (SELECT *, {NORM.format('m1')} n1, {NORM.format('m2')} n2 FROM pr) SELECT game_id, ply, levenshtein(m1, m2) AS distance, round(CASE WHEN n1 = n2 OR n1 = '' OR n2 = '' THEN 0.0::DOUBLE ELSE levenshtein(n1, n2)::DOUBLE / greatest(length(n1), length(n2)) END, 6) AS strength FROM n"),
    "fn10_count_changes": oracle("candidates", f"{PAIRS} SELECT game_id, ply, CAST(({PIECE.format('m1')} <> {PIECE.format('m2')})::INT + ({part('m1', 5)} <> {part('m2', 5)})::INT + ({part('m1', 6)} <> {part('m2', 6)})::INT + ({part('m1', 4)} <> {part('m2', 4)})::INT + (contains(m1, '+') <> contains(m2, '+'))::INT AS BIGINT) AS changes FROM pr"),
    "fn11_semantic_changes": oracle("candidates", f"""{PAIRS}, x AS (SELECT *, ({PIECE.format('m1')} <> {PIECE.format('m2')}) AS piece, ({part('m1', 5)} <> {part('m2', 5)}) AS f, ({part('m1', 6)} <> {part('m2', 6)}) AS r, {part('m1', 4)} = 'x' AS x1, {part('m2', 4)} = 'x' AS x2, contains(m1, '+') AS k1, contains(m2, '+') AS k2 FROM pr)
SELECT game_id, ply, concat_ws(',', CASE WHEN k1 AND NOT k2 THEN 'check_removed' END, CASE WHEN x1 AND NOT x2 THEN 'capture_removed' END, CASE WHEN piece THEN 'piece_changed' END) AS reasons,
  piece::INT + f::INT + r::INT + (x1 <> x2)::INT + (k1 <> k2)::INT <= 2 AND NOT (f AND r) AS safe FROM x"""),
    "fn12_complexity": oracle("candidates", f"SELECT {ID}, CAST(CASE WHEN regexp_matches(move, '[x+#=]') THEN 2 WHEN regexp_matches(move, '^[KQRBN]') THEN 1 ELSE 0 END AS BIGINT) AS complexity FROM candidates"),
    "fn13_result_and_date": oracle("pairings", "SELECT pairing_id, replace(replace(result_raw, ' ', ''), '½-½', '1/2-1/2') AS result, strftime(played_at, '%Y.%m.%d') AS date FROM pairings"),
    "fn19_sheet_checksum": oracle("candidates", """WITH l AS (SELECT game_id, sheet, string_agg((ply // 2 + 1) || CASE WHEN ply % 2 = 0 THEN '.W ' ELSE '.B ' END || move, chr(10) ORDER BY ply) AS t FROM candidates WHERE rk = 0 GROUP BY ALL)
SELECT game_id, sheet, printf('%08x', list_reduce([2166136261::BIGINT] || list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295)) AS checksum FROM l"""),
    "fn13_round_codes": oracle("pairings", f"""WITH c AS (SELECT pairing_id, ([{", ".join(f"'{x}'" for x in CELLS)}])[pairing_id % {len(CELLS)} + 1] AS cell, 'Round' || ([' 2024-May-0', ' 2024.05.0', ' 2024/05/0', ' 2024-05-0', ''])[pairing_id % 5 + 1] || (pairing_id % 9) || ' hall' AS line FROM pairings)
SELECT pairing_id, CASE WHEN cell IN ('1-0', '10', '+-', '1:0', '1 0', '1-') THEN '1-0' WHEN cell IN ('0 - 1', '-+') THEN '0-1' WHEN cell IN ('½-½', '1/2-1/2', '0.5:0.5', '==', '5=', '½½', 'Draw', '=0') THEN '1/2-1/2' ELSE '*' END AS result, CASE pairing_id % 5 WHEN 0 THEN '2024-May-0' || pairing_id % 9 WHEN 3 THEN '' WHEN 4 THEN '' ELSE '2024.05.0' || pairing_id % 9 END AS date FROM c"""),
    "fn14_headers": oracle("pairings", "SELECT pairing_id, 'Tournament' AS event, CASE WHEN board IS NULL THEN round::VARCHAR ELSE round || '.' || board END AS round_tag, white_name AS white, black_name AS black, replace(replace(result_raw, ' ', ''), '½-½', '1/2-1/2') AS result, CASE WHEN black_rtg <> 0 THEN CASE WHEN white_rtg <> 0 THEN 'BlackElo,WhiteElo' ELSE 'BlackElo' END WHEN white_rtg <> 0 THEN 'WhiteElo' ELSE '' END AS optional_tags, nullif(white_rtg, 0) AS white_elo FROM pairings"),
    "fn15_name_keys": oracle("pairings", "SELECT pairing_id, lower(white_name) AS white_key, least(lower(white_name), lower(black_name)) || '|' || greatest(lower(white_name), lower(black_name)) AS pair_key, CASE WHEN white_sno % 3 <> 0 THEN 'sno:' || section || ':' || (white_sno % 3 * white_sno) ELSE 'name:' || lower(white_name) END AS player FROM pairings"),
    "fn16_scan_name": oracle("files", f"WITH t AS (SELECT file_id, {_tok(STEM, 'r')} AS round, {_tok(STEM, 'b')} AS board, {_tok(STEM, 'p')} AS page, CASE WHEN path LIKE 'OpenR%' THEN 'Open' END AS section FROM files) SELECT file_id, CASE WHEN round IS NOT NULL OR board IS NOT NULL THEN section END AS section, round, board, CASE WHEN round IS NOT NULL OR board IS NOT NULL THEN page END AS page FROM t"),
    "fn17_scan_path": oracle("files", f"SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'U1300' END AS section, CASE WHEN file_id % 4 < 2 THEN CAST(file_id % 9 + 1 AS BIGINT) END AS round, CASE WHEN file_id % 4 < 2 THEN CAST(file_id // 72 + 1 AS BIGINT) END AS board, {_tok(STEM, 'p')} AS page FROM files"),
    "fn18_layout_match": oracle("files", f"{LAYOUTS} SELECT file_id, CASE WHEN cached IS NULL THEN true WHEN contains(cached, '@') THEN cached = current ELSE cached = 'grid8x2' END AS matches FROM l"),
    "fn20_confusable": oracle("candidates", f"WITH k(a, b) AS (VALUES ('R','K'),('K','R'),('B','R'),('R','B'),('N','K'),('K','N'),('B','N'),('N','B')) SELECT {ID}, b || move[2:] AS variant FROM candidates JOIN k ON move[1] = a"),
    "fn21_forced_review": oracle("candidates", f"{PAIRS} SELECT game_id, ply FROM pr WHERE ply % 6 <> 0 AND ({NORM.format('m1')} <> {NORM.format('m2')} OR c1 < 0.5)"),
    "fn22_filter_games": oracle("pairings", "SELECT pairing_id, section, round FROM pairings WHERE (round IN (1, 2) AND section = 'S1') OR (section = 'S2' AND (white_sno = 7 OR black_sno = 7))"),
    "fn23_similarity_abstain": oracle("candidates", f"{PAIRS} SELECT game_id, ply, round(CASE WHEN (ply % 10 = 0) <> (ply % 15 = 0) THEN 0.474::DOUBLE ELSE c1 END, 6) AS similarity FROM pr"),
}
