"""Queries of streams, SQL functions and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoply.fixtures import oracle, view
from duoply.functions import similarity as S
from duoply.functions import sql as Q
from duoply.operators import align as A
from duoply.plans.columns import NORM, PAIRS, _pairs, likeness_sql
from duoply.plans.linkage import COMPARE
from duoply.plans.readings import REPEATS, cand
from duoply.sources import readings as R
from duoply.sources.shared import new_folder
from duoply.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str = "", views: str = "candidates"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(views, sql)
        return f

    return add


POSITIONAL = "list_sum([CASE WHEN {0}[i] = {1}[i] THEN 100.0::DOUBLE ELSE coalesce(map_extract(MAP {{" + ", ".join(f"'{k}': {v}" for k, v in S.LOOK_ALIKE.items()) + "}}, {0}[i] || {1}[i])[1], 0) * 0.3::DOUBLE END FOR i IN range(1, least(length({0}), length({1})) + 1)]) / greatest(length({0}), length({1})) - 10 * abs(length({0}) - length({1}))"


@query(f"{PAIRS} SELECT game_id, ply, round(CASE WHEN m1 = m2 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, {POSITIONAL.format('m1', 'm2')})) END, 6) AS similarity FROM pr")
def fn09_positional_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.on_distinct_pairs(_pairs(spark, sf_dir), "m1", "m2", S.positional, "similarity")
    return found.select("game_id", "ply", F.round("similarity", 6).alias("similarity"))


@query(f"WITH pr AS (SELECT x.game_id, x.ply, x.move AS a, y.move AS b FROM candidates x JOIN candidates y ON x.game_id = y.game_id AND x.ply = y.ply AND x.sheet = 1 AND y.sheet = 2 AND x.rk = 0 AND y.rk = 0), {likeness_sql('pr')} SELECT game_id, ply, round(sim, 6) AS similarity FROM pr JOIN sim USING (a, b)")
def fn09_move_similarity(spark, sf_dir):
    found = S.on_distinct_pairs(_pairs(spark, sf_dir), "m1", "m2", S.structured, "similarity")
    return found.select("game_id", "ply", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH m AS (SELECT DISTINCT sheet, move, length(move) AS n, CASE WHEN move[1] IN ('K', 'Q', 'R', 'B', 'N') THEN move[1] ELSE 'P' END AS p, regexp_extract(move, '([a-h][1-8])[^a-h]*$', 1) AS s FROM candidates WHERE sheet = 1 OR rk = 0),
pr AS (SELECT r.move AS a, v.move AS b FROM m r JOIN m v ON r.sheet = 2 AND v.sheet = 1 AND (r.s = v.s OR (r.p = v.p AND (r.s[1] = v.s[1] OR r.s[2] = v.s[2])))), {likeness_sql('pr')}
SELECT a AS reading, b AS move, round(sim * 100, 4) AS similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sim * 100, 4) DESC, b) AS INTEGER) AS place FROM sim QUALIFY place <= 3""")
def jn14_rank_vocabulary(spark, sf_dir):
    c = cand(spark, sf_dir)
    return S.rank_vocabulary(c.where("sheet = 2 and rk = 0").select(F.col("move").alias("reading")), c.where("sheet = 1").select("move"))


@query(REPEATS.format(cells="candidates"))
def win04_repeated_rows(spark, sf_dir):
    """Consecutive full moves of one sheet that look alike."""
    return A.repeated_rows(cand(spark, sf_dir)).withColumns({"white": F.round("white", 6), "black": F.round("black", 6)})


@query("SELECT operator_id, open_game, round(sum(gap), 6) AS seconds FROM (SELECT operator_id, open_game, (epoch_us(lead(ts) OVER (PARTITION BY operator_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM interactions) WHERE gap > 0 AND gap <= 7200 GROUP BY ALL", "interactions")
def str01_stream_attention(spark, sf_dir):
    """Dealt to micro-batches by number, so that events come out of order; a last event far ahead moves the watermark past all others."""
    path = new_folder(spark)
    rows = view(spark, sf_dir, "interactions")
    last = rows.limit(1).select(F.lit(-1).cast("long").alias("operator_id"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"), F.lit("end").alias("open_game"), F.lit(-1).cast("long").alias("event_id"))
    stream = jobs.dealt(spark, rows.select("operator_id", "ts", "open_game", "event_id"), f"{path}/in", "event_id")
    last.coalesce(1).write.mode("append").parquet(f"{path}/in")
    found = jobs.drained(jobs.attention(stream, seconds=7200, late="400 days"), path)
    return found.groupBy("operator_id", "open_game").agg(F.round(F.sum("seconds"), 6).alias("seconds"))


@query("""WITH RECURSIVE step AS (SELECT DISTINCT game_id, 0::BIGINT AS seq, []::BIGINT[] AS ids, false AS accepted FROM edits UNION ALL
SELECT s.game_id, e.seq, CASE WHEN e.op = 'insert' AND e.pos <= len(ids) THEN ids[:e.pos] || [e.event_id] || ids[e.pos + 1:] WHEN e.op = 'delete' AND e.pos < len(ids) THEN ids[:e.pos] || ids[e.pos + 2:] ELSE ids END, CASE e.op WHEN 'insert' THEN e.pos <= len(ids) ELSE e.pos < len(ids) END FROM step s JOIN edits e ON e.game_id = s.game_id AND e.seq = s.seq + 1)
SELECT game_id, seq, accepted, len(ids) AS length FROM step WHERE seq > 0""", "edits")
def str02_stream_edit_replay(spark, sf_dir):
    path = new_folder(spark)
    e = view(spark, sf_dir, "edits").drop("ts").withColumn("pos", F.col("pos").cast("long"))
    return jobs.drained(jobs.edits(jobs.dealt(spark, e, f"{path}/in", "seq")), path).drop("_batch")


@query("SELECT game_id, sheet, ply, CAST(rk AS INTEGER) AS rk, move FROM candidates UNION ALL SELECT game_id, sheet, ply, CAST(rk AS INTEGER), move FROM candidates WHERE game_id % 4 = 1")
def str03_stream_ingest(spark, sf_dir):
    """All reading files land, land once more in another folder with the same name, size and time, and a quarter of the games lands in changed files: these cells come twice, all others once."""
    path = new_folder(spark)
    files = R.render_readings(cand(spark, sf_dir))
    R.write_readings(files.repartition(4, "game_id"), f"{path}/in/first")
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{path}/in")
    fs = there.getFileSystem(hadoop)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(there, "first"), fs, jvm.org.apache.hadoop.fs.Path(there, "again"), False, hadoop)
    for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(there, "first")):  # four files
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f"{path}/in/again", f.getPath().getName()), f.getModificationTime(), -1)
    R.write_readings(files.where("game_id % 4 = 1"), f"{path}/in/changed")
    return jobs.drained(jobs.ingest_readings(spark, f"{path}/in", files=3), path).select("game_id", "sheet", "ply", "rk", "move")


@query("WITH s AS (SELECT game_id, status, row_number() OVER (ORDER BY game_id, method, ply, san, similarity, status) AS seq FROM (SELECT DISTINCT * FROM fixes)) SELECT game_id, arg_max(status, seq) AS status, count(*) AS reports FROM s GROUP BY ALL", "fixes")
def str04_stream_status(spark, sf_dir):
    path = new_folder(spark)
    f = view(spark, sf_dir, "fixes").distinct()
    rows = f.select("game_id", "status", F.struct("method", "ply", "san", "similarity", "status").alias("seq"))
    got = jobs.drained(jobs.status(jobs.dealt(spark, rows, f"{path}/in")), path, mode="update")
    return got.groupBy("game_id").agg(F.max_by("status", "_batch").alias("status"), F.max_by("reports", "_batch").alias("reports"))


@query("WITH g AS (SELECT game_id, arg_max(status, (method, ply, san, similarity, status)) AS status FROM fixes GROUP BY ALL) SELECT status, count(*) AS games FROM g GROUP BY ALL", "fixes")
def str04_status_totals(spark, sf_dir):
    """The totals after the last of three micro-batches of reports."""
    path = new_folder(spark)
    order = F.concat_ws("|", "method", F.format_string("%010d", "ply"), "san", F.format_string("%018.9f", "similarity"), "status")
    rows = view(spark, sf_dir, "fixes").distinct().select("game_id", "status", order.alias("seq"))
    totals = jobs.status_totals(jobs.dealt(spark, rows, f"{path}/in"), path)
    return totals.groupBy("status").agg(F.max_by("games", "_batch").alias("games")).where("games > 0")


@query(f"""WITH {COMPARE}, so AS (SELECT game_id, bool_and(status = 'SOLVED') AS solved FROM st GROUP BY ALL) SELECT game_id, CASE WHEN NOT solved THEN 'C' WHEN disagreements = 0 AND total <= 5 AND min_similarity >= 0.7 THEN 'A' WHEN disagreements <= 2 AND total <= 12 THEN 'B' ELSE 'C' END AS tier FROM cmp JOIN so USING (game_id)""", "fixes")
def str04_stream_triage(spark, sf_dir):
    path = new_folder(spark)
    got = jobs.retriaged(jobs.dealt(spark, view(spark, sf_dir, "fixes"), f"{path}/in", "ply", "san"), path)
    return got.groupBy("game_id").agg(F.max_by("tier", "_batch").alias("tier"))


@query("""WITH n AS (SELECT *, replace(replace(trim(regexp_replace(coalesce(move, ''), '[+#]', '', 'g')), '0-0-0', 'O-O-O'), '0-0', 'O-O') AS norm FROM candidates)
SELECT game_id, sheet, ply, rk, norm, regexp_extract(move, '([a-h][1-8])[+#]*$', 1) AS target, coalesce(nullif(regexp_extract(norm, '^[KQRBN]'), ''), 'P') AS piece, contains(norm, 'x') AS capture, CASE WHEN contains(norm, 'x') AND regexp_full_match(norm, 'x[a-h][1-8]') THEN 'invalid' ELSE 'standard' END AS notation,
  (ply // 2 + 1) || CASE WHEN ply % 2 = 0 THEN '.W' ELSE '.B' END AS label, ply AS back, CASE WHEN regexp_matches(move, '[x+#]') THEN 2 WHEN regexp_matches(move, '^[KQRBN]') THEN 1 ELSE 0 END AS complexity, norm = '' AS truncated FROM n""")
def udf01_register_functions(spark, sf_dir):
    Q.register(spark)
    cand(spark, sf_dir).createOrReplaceTempView("candidates_for_functions")
    # functions are called once for each text and each ply, not for each row
    return spark.sql("""WITH m AS (SELECT move AS text, normalize_move(move) AS norm, move_target(move) AS target, parse_move(move) AS parsed, notation_class(move) AS notation, move_complexity(move) AS complexity, is_truncated(move) AS truncated FROM (SELECT DISTINCT move FROM candidates_for_functions)),
      p AS (SELECT ply AS at, ply_label(ply) AS label, label_ply(ply_label(ply)) AS back FROM (SELECT DISTINCT ply FROM candidates_for_functions))
      SELECT game_id, sheet, ply, rk, norm, target, parsed.piece AS piece, parsed.capture AS capture, notation, label, back, complexity, truncated FROM candidates_for_functions LEFT JOIN m ON text <=> move LEFT JOIN p ON at <=> ply""")


@query(f"WITH pr AS (SELECT x.game_id, x.ply, x.move AS a, y.move AS b FROM candidates x JOIN candidates y ON x.game_id = y.game_id AND x.ply = y.ply AND x.sheet = 1 AND y.sheet = 2 AND x.rk = 0 AND y.rk = 0), {likeness_sql('pr')} SELECT game_id, ply, round(sim, 6) AS similarity FROM pr JOIN sim USING (a, b) WHERE sim >= 0.5")
def udf01_similarity_in_sql(spark, sf_dir):
    """Pairs of readings that one SQL text compares and filters."""
    Q.register(spark)
    cand(spark, sf_dir).createOrReplaceTempView("candidates_for_functions")
    return spark.sql("""WITH t AS (SELECT * FROM candidates_for_functions WHERE rk = 0), d AS (SELECT DISTINCT x.move AS a, y.move AS b FROM t x JOIN t y ON x.game_id = y.game_id AND x.ply = y.ply AND x.sheet = 1 AND y.sheet = 2),
      s AS (SELECT a, b, move_similarity(a, b) AS similarity FROM d)
      SELECT x.game_id, x.ply, round(similarity, 6) AS similarity FROM t x JOIN t y ON x.game_id = y.game_id AND x.ply = y.ply AND x.sheet = 1 AND y.sheet = 2 JOIN s ON s.a = x.move AND s.b = y.move WHERE similarity >= 0.5""")


@query("SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY ply) - 1 AS INTEGER) AS ply, move FROM candidates WHERE sheet = 1 AND rk = 0")
def udf02_moves_from_text(spark, sf_dir):
    Q.register(spark)
    number = F.when(F.col("ply") % 2 == 0, F.concat((F.floor(F.col("ply") / 2) + 1).cast("string"), F.lit(". "))).otherwise("")
    t = cand(spark, sf_dir).where("sheet = 1 and rk = 0").groupBy("game_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", F.concat(number, "move").alias("m")))), lambda x: x["m"]), " ").alias("text"))
    t.withColumn("text", F.concat("text", F.lit(" {end} 1-0"))).createOrReplaceTempView("movetexts")
    return spark.sql("SELECT game_id, m.ply, m.move FROM movetexts, LATERAL moves_from_text(text) m")
