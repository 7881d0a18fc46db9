"""Queries of alignment, replay and symbol evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoply.fixtures import oracle, table, view
from duoply.operators import align as A
from duoply.operators import evidence as E
from duoply.plans.columns import NORM
from duoply.plans.readings import REPEATS, cand, shifted
from duoply.sources import games as G
from duoply.sources.shared import kept, new_folder

QUERIES, ORACLES = {}, {}


def query(sql: str = "", views: str = "candidates"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(views, sql) if views else sql
        return f

    return add


#: The shifted cells in DuckDB.
SHIFTED = f"""c AS MATERIALIZED (SELECT game_id, sheet, ply + CASE WHEN sheet = 2 AND game_id % 3 = 0 THEN 4 ELSE 0 END AS ply, rk, {NORM.format('move')} AS norm, conf FROM candidates)"""
#: The global alignment of the cells c in DuckDB: scores by antidiagonals, ways from one to the next, and back.
ALIGNED = """one AS (SELECT game_id, ply AS i, norm, arg_max(conf, rk) AS a FROM c WHERE sheet = 1 AND norm <> '' GROUP BY ALL),
o AS MATERIALIZED (SELECT one.game_id, one.i, c.ply AS j, sum(one.a + c.conf) AS overlap FROM one JOIN c ON c.sheet = 2 AND c.game_id = one.game_id AND c.norm = one.norm GROUP BY ALL),
sz AS MATERIALIZED (SELECT game_id, coalesce(max(ply) FILTER (sheet = 1) + 1, 0) AS n, coalesce(max(ply) FILTER (sheet = 2) + 1, 0) AS m FROM c GROUP BY game_id),
cells AS (SELECT game_id, n, m, d, unnest(range(0, n + 1)) AS i FROM (SELECT game_id, n, m, unnest(range(1, n + m + 1)) AS d FROM sz)),
sc AS MATERIALIZED (SELECT x.game_id, x.d, list({'i': x.i, 'on': x.i <= x.d AND x.d - x.i <= x.m, 's': coalesce(o.overlap, 0.0::DOUBLE) - 0.05::DOUBLE} ORDER BY x.i) AS s FROM cells x LEFT JOIN o ON o.game_id = x.game_id AND o.i = x.i - 1 AND o.j = x.d - x.i - 1 GROUP BY ALL),
dp(game_id, d, older, old, ways) AS (
  SELECT game_id, 0::BIGINT, list_transform(range(0, n + 1), lambda i: NULL::DOUBLE), list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE END), NULL::INTEGER[] FROM sz
  UNION ALL
  SELECT game_id, d, old, list_transform(best, lambda x: x.v), list_transform(best, lambda x: x.k) FROM (
    SELECT game_id, d, old, list_transform(list_zip(first, old), lambda x: CASE WHEN x[2] - 0.3::DOUBLE > x[1].v + 1e-9 AND x[1].k < 2 THEN {'v': x[2] - 0.3::DOUBLE, 'k': 2} ELSE x[1] END) AS best FROM (
      SELECT p.game_id, w.d, p.old, list_transform(list_zip(w.s, list_prepend(NULL, p.older[:-2]), list_prepend(NULL, p.old[:-2])), lambda x: CASE WHEN NOT x[1].on THEN NULL WHEN x[1].i = 0 THEN {'v': -0.3::DOUBLE * w.d, 'k': 2} WHEN x[1].i = w.d THEN {'v': -0.3::DOUBLE * w.d, 'k': 1}
        WHEN x[3] - 0.3::DOUBLE > x[2] + x[1].s + 1e-9 THEN {'v': x[3] - 0.3::DOUBLE, 'k': 1} ELSE {'v': x[2] + x[1].s, 'k': 0} END) AS first FROM dp p JOIN sc w ON w.game_id = p.game_id AND w.d = p.d + 1))),
steps AS MATERIALIZED (SELECT game_id, d, ways FROM dp WHERE d > 0),
walk(game_id, i, j, k, step) AS (
  SELECT game_id, n, m, -1, 0::BIGINT FROM sz
  UNION ALL
  SELECT game_id, CASE WHEN way <> 2 THEN i - 1 ELSE i END, CASE WHEN way <> 1 THEN j - 1 ELSE j END, way, step + 1 FROM (SELECT w.*, t.ways[w.i + 1] AS way FROM walk w JOIN steps t ON t.game_id = w.game_id AND t.d = w.i + w.j WHERE w.i + w.j > 0)),
path AS (SELECT game_id, max(step) OVER (PARTITION BY game_id) - step AS step, k, CASE WHEN k = 2 THEN -1 ELSE i END AS i, CASE WHEN k = 1 THEN -1 ELSE j END AS j FROM walk WHERE k >= 0)"""


@query(f"""WITH RECURSIVE {SHIFTED},
{ALIGNED}
SELECT p.game_id, p.step::INTEGER AS step, CASE p.k WHEN 0 THEN 'match' WHEN 1 THEN 'gap_s2' ELSE 'gap_s1' END AS kind, p.i::INTEGER AS i, p.j::INTEGER AS j, round(coalesce(o.overlap, 0.0::DOUBLE), 6) AS score
FROM path p LEFT JOIN o ON p.k = 0 AND o.game_id = p.game_id AND o.i = p.i AND o.j = p.j""")
def seq01_align_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.align(shifted(spark, sf_dir)), "score")


@query()
def seq02_extract_gap_suggestion(spark, sf_dir):
    return A.gap_suggestions(faulty(spark, sf_dir))


def faulty(spark, sf_dir) -> DataFrame:
    """Candidates in which the second sheet lacks two moves from ply 16 on in every third game, writes one twice at ply 20 in others, and is confident where both readings agree."""
    c, g, late = cand(spark, sf_dir), F.col("game_id") % 3, F.col("sheet") == 2
    gone = c.where(~(late & (g == 0) & F.col("ply").between(16, 19)))
    ply = F.when(late & (g == 0) & (F.col("ply") > 19), F.col("ply") - 4).when(late & (g == 1) & (F.col("ply") >= 20), F.col("ply") + 2).otherwise(F.col("ply"))
    twice = c.where(late & (g == 1) & F.col("ply").between(18, 19)).withColumn("ply", F.col("ply") + 2)
    return gone.withColumn("ply", ply).unionByName(twice)


@query()
def seq03_alignment_cascade(spark, sf_dir):
    return A.cascade(faulty(spark, sf_dir))


#: Windows of eight plies of the cells c in DuckDB, each with what the sheets share at offsets -12 to 12, folded in order.
OFFSETS = """o AS (SELECT a.game_id, a.i, b.ply - a.i AS shift, sum(a.a + b.conf) AS overlap FROM (SELECT game_id, ply AS i, norm, arg_max(conf, rk) AS a FROM c WHERE sheet = 1 AND norm <> '' GROUP BY ALL) a JOIN c b ON b.sheet = 2 AND b.norm <> '' AND b.game_id = a.game_id AND b.norm = a.norm AND abs(b.ply - a.i) <= 12 GROUP BY ALL),
l AS (SELECT game_id, greatest(0, max(ply) - 7) AS last FROM c GROUP BY game_id), st AS (SELECT game_id, unnest(list_distinct(list_append(list_transform(range(0, last // 2 + 1), lambda k: k * 2), last))) AS start FROM l),
cells AS (SELECT st.game_id, st.start, f.f AS shift, round(coalesce(sum(o.overlap), 0), 9) AS s FROM st CROSS JOIN (SELECT unnest(range(-12, 13)) AS f) f LEFT JOIN o ON o.game_id = st.game_id AND o.shift = f.f AND o.i BETWEEN st.start AND st.start + 7 GROUP BY ALL),
win AS MATERIALIZED (SELECT game_id, start, list(s ORDER BY shift) AS s, row_number() OVER (PARTITION BY game_id ORDER BY start) AS k FROM cells GROUP BY game_id, start),
walk(game_id, k, next, start, base, best, at_base, at_best, transition) AS (
  SELECT game_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, false FROM l
  UNION ALL
  SELECT game_id, k, CASE WHEN best <> base AND at_best > at_base + 0.2::DOUBLE THEN best ELSE base END, start, base, best, at_base, at_best, best <> base AND at_best > at_base + 0.2::DOUBLE FROM (
    SELECT w.game_id, w.k, w.start, p.next AS base, list_max(near) AS at_best, s[p.next + 13] AS at_base, greatest(-12, p.next - 4) + list_position(near, list_max(near)) - 1 AS best
    FROM walk p JOIN (SELECT * FROM win) w ON w.game_id = p.game_id AND w.k = p.k + 1, LATERAL (SELECT s[greatest(-12, p.next - 4) + 13 : least(12, p.next + 4) + 13] AS near)))"""


@query(f"WITH RECURSIVE {SHIFTED},\n{OFFSETS} SELECT game_id, start, base AS before, best AS offset, best - base AS delta, round(at_base, 6) AS at_base, round(at_best, 6) AS at_best FROM walk WHERE transition")
def seq04_running_offset(spark, sf_dir):
    return rounded(A.running_offset(shifted(spark, sf_dir)), "at_base", "at_best")


@query(f"WITH RECURSIVE {SHIFTED},\n{OFFSETS} SELECT game_id, start, base::INTEGER AS base, best::INTEGER AS best, round(at_base, 6) AS at_base, round(at_best, 6) AS at_best, transition FROM walk WHERE k > 0")
def seq04_window_map(spark, sf_dir):
    return rounded(A.offset_windows(shifted(spark, sf_dir)), "at_base", "at_best")


#: The faulty cells of faulty() in DuckDB.
FAULTY = f"""f AS (SELECT * REPLACE (CASE WHEN sheet = 2 AND game_id % 3 = 0 AND ply > 19 THEN ply - 4 WHEN sheet = 2 AND game_id % 3 = 1 AND ply >= 20 THEN ply + 2 ELSE ply END AS ply) FROM candidates WHERE NOT (sheet = 2 AND game_id % 3 = 0 AND ply BETWEEN 16 AND 19)
  UNION ALL SELECT * REPLACE (ply + 2 AS ply) FROM candidates WHERE sheet = 2 AND game_id % 3 = 1 AND ply BETWEEN 18 AND 19),
c AS MATERIALIZED (SELECT game_id, sheet, ply, rk, {NORM.format('move')} AS norm, conf FROM f)"""


@query(f"""WITH RECURSIVE {FAULTY},
{OFFSETS},
repeats AS MATERIALIZED ({REPEATS.format(cells='f')}),
long_enough AS (SELECT game_id FROM f WHERE rk = 0 GROUP BY game_id HAVING least(count_if(sheet = 1), count_if(sheet = 2)) >= 6),
moved AS (SELECT game_id, start // 2 + 1 AS move, CASE WHEN start % 2 = 0 THEN 'w' ELSE 'b' END AS half, abs(best - base) AS size, CASE WHEN best < base THEN 1 ELSE 2 END AS ahead, at_best < 0.4::DOUBLE AS weak FROM walk WHERE transition),
free AS (SELECT * FROM moved v WHERE size <> 2 OR NOT EXISTS (SELECT 1 FROM repeats r WHERE r.game_id = v.game_id AND r.sheet = v.ahead)),
every AS (SELECT game_id, 'repeat' AS cause, sheet, 'delete' AS action, r.at // 2 + 2 AS move, 'w' AS half, 'high' AS confidence, r.at // 2 + 1 AS priority FROM repeats r
  UNION ALL SELECT game_id, 'shift_2', ahead, 'delete', move, 'w', CASE WHEN weak THEN 'low' ELSE 'medium' END, move + 1000 FROM free WHERE size = 2
  UNION ALL SELECT game_id, 'shift_2', 3 - ahead, 'insert_pair', move, half, 'low', move + 1100 FROM free WHERE size = 2
  UNION ALL SELECT game_id, 'shift_4', 3 - ahead, 'insert_double', move, 'w', CASE WHEN weak THEN 'low' ELSE 'medium' END, move + 800 FROM free WHERE size = 4
  UNION ALL SELECT game_id, 'shift_1', ahead, 'investigate', move, half, 'low', move + 1500 FROM free WHERE size = 1
  UNION ALL SELECT game_id, 'shift_3', ahead, 'investigate', move, half, 'low', move + 1700 FROM free WHERE size = 3)
SELECT every.* REPLACE (sheet::INTEGER AS sheet) FROM every JOIN long_enough USING (game_id)""")
def seq05_alignment_suggestions(spark, sf_dir):
    c = faulty(spark, sf_dir)
    return A.shift_suggestions(c, A.running_offset(c), A.repeated_rows(c))


@query()
def seq06_auto_apply_edits(spark, sf_dir):
    return A.auto_apply(faulty(spark, sf_dir), threshold=0.5)


@query()
def seq06_edited_cells(spark, sf_dir):
    c = faulty(spark, sf_dir)
    return A.edited_cells(c, A.auto_apply(c, threshold=0.5))


@query()
def seq06_reverted_cells(spark, sf_dir):
    """The cells as they were after each game's first edit."""
    c = faulty(spark, sf_dir)
    return A.edited_cells(c, A.auto_apply(c, threshold=0.5), before=1)


def log(spark, sf_dir) -> DataFrame:
    """Edits whose positions fit: three inserts, then a delete at the front; with recorded lengths. One game in ten inserts past the end at its fifth edit, another one records a wrong length at its sixth."""
    before = F.col("seq") - 1 - 2 * F.floor((F.col("seq") - 1) / 4)
    delete = F.col("seq") % 4 == 0
    pos = F.when(delete, 0).when((F.col("game_id") % 10 == 7) & (F.col("seq") == 5), 999).otherwise(F.col("event_id") % (before + 1))
    length = before + F.when(delete, -1).otherwise(1) + F.when((F.col("game_id") % 10 == 8) & (F.col("seq") == 6), 3).otherwise(0)
    return view(spark, sf_dir, "edits").select("game_id", "seq", F.when(delete, "delete").otherwise("insert").alias("op"), pos.cast("long").alias("pos"), "event_id", length.cast("long").alias("length"))


LOG = """lg AS (SELECT game_id, seq, CASE WHEN seq % 4 = 0 THEN 'delete' ELSE 'insert' END AS op, CASE WHEN seq % 4 = 0 THEN 0 WHEN game_id % 10 = 7 AND seq = 5 THEN 999 ELSE event_id % (seq - 2 * ((seq - 1) // 4)) END AS pos, event_id FROM edits),
good AS (SELECT game_id, max(seq) AS n FROM lg GROUP BY game_id HAVING count_if((game_id % 10 = 7 AND seq = 5) OR (game_id % 10 = 8 AND seq = 6)) = 0),
step AS (SELECT game_id, 0::BIGINT AS seq, []::BIGINT[] AS ids FROM good UNION ALL SELECT s.game_id, l.seq, CASE op WHEN 'insert' THEN ids[:pos] || [event_id] || ids[pos + 1:] ELSE ids[:pos] || ids[pos + 2:] END FROM step s JOIN lg l ON l.game_id = s.game_id AND l.seq = s.seq + 1)"""


@query(f"""WITH RECURSIVE {LOG}, v AS (SELECT g.game_id, b.ids AS b, a.ids AS a FROM good g JOIN step a ON a.game_id = g.game_id AND a.seq = g.n JOIN step b ON b.game_id = g.game_id AND b.seq = g.n - CAST(ceil(g.n / 10.0) AS BIGINT)),
bi AS (SELECT game_id, unnest(b) AS id, unnest(range(0, len(b))) AS i FROM v), ai AS (SELECT game_id, unnest(a) AS id, unnest(range(0, len(a))) AS i FROM v),
j AS (SELECT coalesce(bi.game_id, ai.game_id) AS game_id, coalesce(bi.id, ai.id) AS id, bi.i AS bi, ai.i AS ai, ai.i IS NULL AS gone, bi.i IS NULL AS new, bi.i IS NOT NULL AND ai.i IS NOT NULL AND coalesce(bi.id, ai.id) % 7 = 0 AS changed FROM bi FULL JOIN ai ON bi.game_id = ai.game_id AND bi.id = ai.id),
g AS (SELECT game_id, count_if(gone) AS n_gone, count_if(new) AS n_new, count_if(changed) AS n_changed, count(ai) AS length, coalesce(string_agg(id::VARCHAR, ',' ORDER BY bi) FILTER (gone), '') AS deleted, coalesce(string_agg(ai || ':' || id, ',' ORDER BY ai) FILTER (new), '') AS inserted, coalesce(string_agg(id::VARCHAR, ',' ORDER BY ai) FILTER (changed), '') AS updated, min(CASE WHEN gone THEN bi WHEN new OR changed THEN ai END) AS first, coalesce(min(bi) FILTER (gone) > coalesce(max(bi) FILTER (NOT gone AND NOT new), -1), false) AS tail FROM j GROUP BY game_id)
SELECT game_id, CASE WHEN n_gone = 0 AND n_new = 0 THEN 'update' WHEN n_new = 0 AND tail AND n_changed = 0 THEN 'truncate' WHEN n_new = 0 THEN 'duplicate-delete' WHEN n_gone = 0 THEN 'gap-insert' ELSE 'realign' END AS type, first, length, deleted, inserted, updated, '' AS sequence FROM g WHERE n_gone + n_new + n_changed > 0""", "edits")
def seq07_capture_edits(spark, sf_dir):
    """What the last tenth of each game's edits (at least one) changed: a snapshot before it against the whole replay; every seventh cell has another payload in the end."""
    n = F.max("seq").over(Window.partitionBy("game_id"))
    saves = F.filter(F.array(F.when(F.col("seq") == n - F.ceil(n / 10), 0), F.when(F.col("seq") == n, 1)), lambda k: k.isNotNull()).cast("array<long>")
    text = lambda more: F.concat(F.lit("m"), (F.col("id") % 9 + more).cast("string"))
    cells = kept(A.replay(log(spark, sf_dir).withColumn("saves", saves))[0])
    before, after = (cells.where(F.col("save") == k).drop("save") for k in (0, 1))
    return A.capture(before.withColumn("payload", text(F.lit(0))), after.withColumn("payload", text(F.when(F.col("id") % 7 == 0, 1).otherwise(0))))


@query(f"WITH RECURSIVE {LOG}, a AS (SELECT game_id, unnest(range(0, len(ids))) AS i, unnest(ids) AS id FROM step JOIN good USING (game_id) WHERE seq = n) SELECT game_id, i, id, i // 2 + 1 AS num, CASE WHEN i % 2 = 0 THEN 'w' ELSE 'b' END AS color FROM a", "edits")
def seq08_replay_edits(spark, sf_dir):
    return A.replay(log(spark, sf_dir))[0]


@query("SELECT game_id, seq, CASE game_id % 10 WHEN 7 THEN 'insert past the end' ELSE 'length 4 is not 7' END AS reason FROM edits WHERE (game_id % 10 = 7 AND seq = 5) OR (game_id % 10 = 8 AND seq = 6)", "edits")
def seq08_replay_rejects(spark, sf_dir):
    return A.replay(log(spark, sf_dir))[1]


def sessions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first snapshot, entries, last snapshot): each game is saved after every tenth of its edits, and an entry is captured between two savings. Cells get another payload from time to time, and every thirteenth an own number."""
    text = lambda k: F.concat(F.lit("m"), ((F.col("id") + k * F.when(F.col("id") % 5 == 0, 1).otherwise(0)) % 9).cast("string"))
    n = F.max("seq").over(Window.partitionBy("game_id"))
    e = log(spark, sf_dir).withColumn("n", n)
    # one replay for all savings; the key of a snapshot is the game and its number
    saves = F.filter(F.sequence(F.lit(1), F.lit(10)), lambda k: F.ceil(F.col("n") * k / 10) == F.col("seq")).cast("array<long>")
    cells = kept(A.replay(e.withColumn("saves", saves))[0].withColumnsRenamed({"game_id": "g", "save": "k"}))
    # a saving without cells is no snapshot, and games that end without cells have none
    whole = cells.where("k = 10 and i = 0").select("g")
    cells = cells.join(whole, "g", "left_semi").withColumns({"game_id": F.col("g") * 16 + F.col("k"), "payload": text(F.col("k")), "num": F.col("num") + F.when(F.col("id") % 13 == 0, 100).otherwise(0)})
    later = cells.where("k > 1").withColumn("game_id", F.col("game_id") - 1)
    found = A.captured(cells.where("k < 10").select("game_id", "i", "id", "payload"), later.select("game_id", "i", "id", "payload", "num", "color"))
    entries = kept(found.withColumn("n", F.col("game_id") % 16).withColumn("game_id", F.floor(F.col("game_id") / 16)))
    of = lambda k: cells.where(F.col("k") == k).withColumn("game_id", F.col("g")).select("game_id", "i", "id", "payload", "num", "color")
    return of(1), entries, of(10)


#: The snapshots at savings 1 to 10 of each game, from LOG's recursion.
SAVED = f"""{LOG}, tenth AS (SELECT game_id, n, unnest(range(1, 11)) AS k FROM good),
snap AS (SELECT a.game_id, a.k, s.ids FROM tenth a JOIN step s ON s.game_id = a.game_id AND s.seq = CAST(ceil(a.n * a.k / 10.0) AS BIGINT)),
cell AS (SELECT game_id, k, unnest(range(0, len(ids))) AS i, unnest(ids) AS id FROM snap)"""
CELL = "i, id, 'm' || ((id + CASE WHEN id % 5 = 0 THEN 10 ELSE 0 END) % 9) AS payload, i // 2 + 1 + CASE WHEN id % 13 = 0 THEN 100 ELSE 0 END AS num, CASE WHEN i % 2 = 0 THEN 'w' ELSE 'b' END AS color"


@query(f"WITH RECURSIVE {SAVED} SELECT game_id, {CELL} FROM cell WHERE k = 10", "edits")
def seq08_replay_entries(spark, sf_dir):
    """The entries of all savings, applied to the first snapshot, give the last one."""
    first, entries, _ = sessions(spark, sf_dir)
    return A.replay_entries(first.select("game_id", "i", "id", "payload"), entries)[0]


@query(f"""WITH RECURSIVE {SAVED}, f AS (SELECT game_id, game_id % 6 AS fault, len(ids) AS m FROM snap WHERE k = 6)
SELECT game_id, CASE WHEN fault = 4 THEN 9 ELSE 5 END AS n, CASE fault WHEN 1 THEN 'deletes absent cell -1' WHEN 2 THEN 'insert past the end' WHEN 3 THEN 'length ' || m || ' is not ' || (m + 2) WHEN 4 THEN 'no content for cell -4' END AS reason FROM f WHERE fault BETWEEN 1 AND 4""", "edits")
def seq08_entry_rejects(spark, sf_dir):
    """Damaged entries: the fifth deletes a cell that isn't there, inserts past the end or records a wrong length; or the last one inserts a cell without content."""
    first, entries, _ = sessions(spark, sf_dir)
    fault, fifth = F.col("game_id") % 6, F.col("n") == 5
    new = lambda pos, id_: F.array(F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(id_).cast("long").alias("id")))
    ninth = (fault == 4) & (F.col("n") == 9)
    broken = entries.withColumns({
        "deleted": F.when((fault == 1) & fifth, F.array(F.lit(-1).cast("long"))).otherwise(F.col("deleted")),
        "inserted": F.when((fault == 2) & fifth, new(10_000, -2)).when(ninth, F.concat("inserted", new(0, -4))).otherwise(F.col("inserted")),
        "length": F.when((fault == 3) & fifth, F.col("length") + 2).when(ninth, F.col("length") + 1).otherwise(F.col("length")),
    })
    return A.replay_entries(first.select("game_id", "i", "id", "payload"), broken)[1]


def cells(spark, sf_dir) -> DataFrame:
    """Raw scores of symbols, from files of twenty cells in half precision: eight frames of eight symbols, in some files four of sixteen."""
    v = F.col("vec_id").cast("long")
    e = table(spark, sf_dir, "embeddings").select(F.floor(v / 20).alias("f"), (v % 20).alias("cell"), F.col("embedding").alias("values"))
    named = e.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), "cell", "values", F.when(F.col("f") % 11 == 5, 16).otherwise(8).alias("vocab"))
    folder = new_folder(spark)
    G.scatter(G.encode_logits(named).select(F.concat(F.col("file"), F.lit(".logits")).alias("path"), "content"), folder)
    return G.read_logits(spark, folder).select((F.substring("file", 2, 20).cast("long") * 20 + F.col("cell")).alias("cell"), "frames", "symbols", "values")


#: The same in DuckDB: values as half precision keeps them (11 bits), and the log-probabilities of each frame.
FRAMES = """halves AS (SELECT vec_id AS cell, CASE WHEN vec_id // 20 % 11 = 5 THEN 16 ELSE 8 END AS symbols,
  list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x::DOUBLE / pow(2, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END) AS h FROM embeddings),
framed AS (SELECT cell, symbols, t, h[t * symbols + 1 : t * symbols + symbols] AS z FROM (SELECT *, unnest(range(0, 64 // symbols)) AS t FROM halves)),
logp AS (SELECT cell, symbols, t, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) AS p FROM framed)"""


def allowed(spark, sf_dir) -> DataFrame:
    """Four strings for each cell: letters of any shape, one that may need more symbols, and now and then one of an unknown letter."""
    e = table(spark, sf_dir, "embeddings")
    letter = lambda n, of=7: F.substring(F.lit(E.LETTERS), (n % of + 1).cast("int"), F.lit(1))
    v, k = F.col("vec_id"), F.col("label")
    texts = F.array(F.concat(letter(v), letter(k)), F.concat(letter(k), letter(v * 3 + 1), letter(v + k)), F.when(v % 10 == 0, "z").otherwise(letter(v + 2)), F.concat(letter(v * 2, 15), letter(v * 5 + k, 15)))
    return e.select(v.cast("long").alias("cell"), F.explode(F.array_distinct(texts)).alias("text"))


#: Alignments in DuckDB: states (symbols with blanks around them) of each text, and the best and summed scores of reaching each state, frame by frame.
CTC = f"""{FRAMES}, texts AS (SELECT vec_id AS cell, unnest(list_distinct([chr((97 + vec_id % 7)::INT) || chr((97 + label % 7)::INT), chr((97 + label % 7)::INT) || chr((97 + (vec_id * 3 + 1) % 7)::INT) || chr((97 + (vec_id + label) % 7)::INT),
  CASE WHEN vec_id % 10 = 0 THEN 'z' ELSE chr((97 + (vec_id + 2) % 7)::INT) END, chr((97 + vec_id * 2 % 15)::INT) || chr((97 + (vec_id * 5 + label) % 15)::INT)])) AS text FROM embeddings),
chars AS (SELECT cell, text, symbols, [ord(text[i]) - 96 FOR i IN range(1, length(text) + 1)] AS c FROM texts JOIN halves USING (cell)),
states AS (SELECT cell, text, [CASE WHEN k % 2 = 1 THEN 0 ELSE c[k // 2] END FOR k IN range(1, 2 * len(c) + 2)] AS s FROM chars
  WHERE list_max(c) < symbols AND len(c) + len([1 FOR i IN range(2, len(c) + 1) IF c[i] = c[i - 1]]) <= 64 // symbols),
walk(cell, text, s, t, b, f) AS (
  SELECT cell, text, s, 0::BIGINT, [CASE WHEN k <= 2 THEN p[s[k] + 1] ELSE -1e300 END FOR k IN range(1, len(s) + 1)], [CASE WHEN k <= 2 THEN p[s[k] + 1] ELSE -1e300 END FOR k IN range(1, len(s) + 1)] FROM states JOIN logp USING (cell) WHERE t = 0
  UNION ALL
  SELECT w.cell, w.text, w.s, w.t + 1,
    [greatest(b[k], CASE WHEN k > 1 THEN b[k - 1] ELSE -1e300 END, CASE WHEN k > 2 AND s[k] <> 0 AND s[k] <> s[k - 2] THEN b[k - 2] ELSE -1e300 END) + p[s[k] + 1] FOR k IN range(1, len(s) + 1)],
    [list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) FOR x IN [[f[k] + p[s[k] + 1], CASE WHEN k > 1 THEN f[k - 1] + p[s[k] + 1] ELSE -1e300 END, CASE WHEN k > 2 AND s[k] <> 0 AND s[k] <> s[k - 2] THEN f[k - 2] + p[s[k] + 1] ELSE -1e300 END] FOR k IN range(1, len(s) + 1)]]
  FROM walk w JOIN logp l ON l.cell = w.cell AND l.t = w.t + 1),
ends AS (SELECT w.cell, w.text, b[-1] AS b1, b[-2] AS b2, f[-1] AS f1, f[-2] AS f2 FROM walk w JOIN halves h ON h.cell = w.cell AND w.t = 64 // h.symbols - 1),
sc AS (SELECT cell, text, greatest(b1, b2) AS best, greatest(f1, f2) + ln(exp(f1 - greatest(f1, f2)) + exp(f2 - greatest(f1, f2))) AS total FROM texts LEFT JOIN ends USING (cell, text))"""


def ctc(spark, sf_dir) -> DataFrame:
    return E.score_candidates(cells(spark, sf_dir), allowed(spark, sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH RECURSIVE {CTC} SELECT cell, text, round(best, 6) AS best, round(total, 6) AS total FROM sc", "")
def seq09_score_alternatives_ctc(spark, sf_dir):
    return rounded(ctc(spark, sf_dir), "best", "total")


STRICT = [[("abc", 1, 1), ("defg", 0, 2)], [("defg", 1, 1)], [("hij", 2, 3)]]
LENIENT = [[("abcdefgh", 1, 4)]]


def beam_sql(name: str, begins: str, whole: str) -> str:
    """Common table expressions of a beam search in DuckDB: {name}(cell, text, conf, place, whole), the best whole texts or else the best beginning."""
    return f"""{name}b(cell, t, text, last, p) AS (
  SELECT cell, 0::BIGINT, '', 0::BIGINT, 0.0::DOUBLE FROM halves
  UNION ALL
  SELECT cell, t + 1, text, last, p FROM (
    SELECT b.cell, b.t, CASE WHEN y.s = 0 OR y.s = b.last THEN b.text ELSE b.text || chr((96 + y.s)::INT) END AS text, y.s AS last, max(b.p + y.p) AS p FROM {name}b b JOIN symbol y ON y.cell = b.cell AND y.t = b.t GROUP BY ALL)
  WHERE regexp_full_match(text, '{begins}') QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(p, 9) DESC, text, last) <= 15),
{name}e AS (SELECT b.cell, text, max(p) AS p, text <> '' AND regexp_full_match(text, '{whole}') AS whole FROM {name}b b JOIN halves h ON h.cell = b.cell AND b.t = 64 // h.symbols GROUP BY ALL),
{name}t AS (SELECT *, bool_or(whole) OVER (PARTITION BY cell) AS found FROM {name}e QUALIFY row_number() OVER (PARTITION BY cell, whole ORDER BY round(p, 9) DESC, text) <= CASE WHEN whole THEN 5 ELSE 1 END),
{name} AS (SELECT cell, text, whole, row_number() OVER w - 1 AS place, CASE WHEN whole THEN exp(p) / sum(exp(p)) OVER (PARTITION BY cell) WHEN text = '' THEN 0 ELSE 0.1 END AS conf FROM {name}t WHERE whole = found WINDOW w AS (PARTITION BY cell ORDER BY round(p, 9) DESC, text))"""


@query(f"""WITH RECURSIVE {FRAMES}, symbol AS (SELECT cell, t, unnest(range(0, symbols)) AS s, unnest(p) AS p FROM logp), {beam_sql("st", "([a-c][d-g]{0,2}|[d-g]|[hij]{0,3})?", "[a-c][d-g]{0,2}|[d-g]|[hij]{2,3}")}, {beam_sql("le", "[a-h]{0,4}", "[a-h]{1,4}")}
SELECT cell, CASE WHEN whole THEN 'strict' ELSE 'partial' END AS kind, CAST(place AS INTEGER) AS place, text, round(conf, 6) AS conf FROM st
UNION ALL SELECT le.cell, 'lenient', CAST(row_number() OVER (PARTITION BY le.cell ORDER BY le.place) - 1 AS INTEGER), le.text, round(le.conf * 0.5, 6) FROM le LEFT JOIN st ON st.cell = le.cell AND st.text = le.text AND st.whole WHERE le.whole AND st.cell IS NULL""", "")
def seq10_decode_corpus(spark, sf_dir):
    return rounded(E.decode(cells(spark, sf_dir), E.Grammar(STRICT), E.Grammar(LENIENT)), "conf")


def ranked(score: str, least: float, name: str) -> str:
    return f"{name}e AS (SELECT cell, text, {score} AS s, exp({score} - max({score}) OVER (PARTITION BY cell)) AS e FROM sc WHERE {score} IS NOT NULL), {name} AS (SELECT cell, text, e / sum(e) OVER (PARTITION BY cell) AS p, row_number() OVER (PARTITION BY cell ORDER BY s DESC, text) AS place FROM {name}e QUALIFY place <= 5 AND p >= {least})"


@query(f"WITH RECURSIVE {CTC}, {ranked('total', 0.3, 'r')} SELECT cell, text, round(p, 6) AS p, CAST(place AS INTEGER) AS place FROM r", "")
def rnk01_constrained_rank(spark, sf_dir):
    return rounded(E.constrained_rank(ctc(spark, sf_dir)), "p")


@query(f"""WITH RECURSIVE {CTC}, {ranked('best', 0.1, 'a')}, {ranked('total', 0.1, 'b')}, j AS (SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.text, b.text) AS text, least(CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN (a.p + b.p) / 2 * 1.5::DOUBLE ELSE coalesce(a.p, b.p) END, 1.0::DOUBLE) AS p FROM a FULL JOIN b ON a.cell = b.cell AND a.text = b.text)
SELECT cell, text, round(p, 6) AS p, CAST(row_number() OVER (PARTITION BY cell ORDER BY p DESC, text) AS INTEGER) AS place FROM j QUALIFY place <= 5 AND p >= 0.3""", "")
def rnk02_fuse_two_rankings(spark, sf_dir):
    """A reader who takes the best alignment, and one who takes all of them."""
    s = kept(ctc(spark, sf_dir))
    a, b = (E.constrained_rank(s, score=c, least=0.1) for c in ("best", "total"))
    return rounded(E.fuse(a, b), "p")


NAMED = "named AS (SELECT cell, total, unnest([text || CASE WHEN cell % 2 = 0 THEN '+' ELSE '' END] || CASE WHEN cell % 3 = 0 THEN [text] ELSE [] END || CASE WHEN cell % 5 = 0 THEN [text || '=Q#', text || '=R#', text || '=Q'] ELSE [] END) AS text FROM sc WHERE total IS NOT NULL)"


@query(f"""WITH RECURSIVE {CTC}, {NAMED}, k AS (SELECT cell, text, total - ln(sum(exp(total)) OVER w) AS logp FROM named WINDOW w AS (PARTITION BY cell)),
u AS (SELECT cell, text, 0 AS bare, text AS o, logp FROM k UNION ALL SELECT cell, regexp_replace(text, '[+#]+$', ''), 1, text, logp FROM k)
SELECT cell, text, round(arg_min(logp, (bare, o)), 6) AS logp FROM u GROUP BY ALL""", "")
def rnk03_renormalise_over_allowed(spark, sf_dir):
    """Texts under several names: with check signs, some also without, some as promotions that share a score."""
    text, cell = F.col("text"), F.col("cell")
    none = F.array().cast("array<string>")
    names = F.concat(F.array(F.concat(text, F.when(cell % 2 == 0, "+").otherwise(""))), F.when(cell % 3 == 0, F.array(text)).otherwise(none), F.when(cell % 5 == 0, F.array(*(F.concat(text, F.lit(x)) for x in ("=Q#", "=R#", "=Q")))).otherwise(none))
    named = ctc(spark, sf_dir).select("cell", F.explode(names).alias("text"), "total")
    return rounded(E.renormalise(named), "logp")


@query("""WITH c AS (SELECT game_id, ply, rk, move, regexp_extract(move, '^[KQRBN]') AS piece, regexp_extract(move, '[a-h][1-8]') AS target, contains(move, 'x') AS x FROM candidates WHERE sheet = 1),
f AS (SELECT game_id, ply, move, regexp_extract(move, '^[KQRBN]') AS piece, regexp_extract(move, '[a-h][1-8]') AS target, contains(move, 'x') AS x FROM candidates WHERE sheet = 2 AND rk = 0),
p AS (SELECT game_id, ply, avg((piece <> '')::INT) AS pieces, avg(x::INT) AS takes FROM c GROUP BY ALL), s AS (SELECT f.game_id, f.ply, count_if(f.piece <> '' AND c.piece = f.piece) AS same, arg_min(CASE WHEN c.move = f.move THEN 15 WHEN rtrim(c.move, '+#') = rtrim(f.move, '+#') THEN 10 END, c.rk) FILTER (rtrim(c.move, '+#') = rtrim(f.move, '+#')) AS direct FROM f JOIN c USING (game_id, ply) GROUP BY ALL),
t AS (SELECT game_id, ply, target, count(*) AS n FROM c WHERE target <> '' GROUP BY ALL), d AS (SELECT f.game_id, f.ply, sum(CASE WHEN t.target = f.target THEN least(5 * n, 10) WHEN t.target[1] = f.target[1] OR t.target[2] = f.target[2] THEN least(2 * n, 6) ELSE 0 END) AS near FROM f JOIN t USING (game_id, ply) GROUP BY ALL)
SELECT game_id, ply, least(30, least(20, 10 * same) + CASE WHEN piece <> '' AND pieces >= 0.5 THEN 5 ELSE 0 END + coalesce(near, 0) + CASE WHEN x AND takes >= 0.3 THEN 5 ELSE 0 END + coalesce(direct, 0))::BIGINT AS bonus FROM f JOIN p USING (game_id, ply) JOIN s USING (game_id, ply) LEFT JOIN d USING (game_id, ply)""")
def rnk07_pattern_bonus(spark, sf_dir):
    c = cand(spark, sf_dir)
    pool = c.where("sheet = 1").groupBy("game_id", "ply").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "move"))), lambda x: x["move"]).alias("pool"))
    fixes = c.where("sheet = 2 and rk = 0").select("game_id", "ply", "move").join(pool, ["game_id", "ply"])
    return fixes.select("game_id", "ply", E.pattern_bonus(F.col("move"), F.col("pool")).cast("long").alias("bonus"))


@query("""WITH a AS (SELECT game_id, ply, rk, move, conf, (ply % 10)::DOUBLE / 10 AS t FROM candidates WHERE sheet = 1), p AS (SELECT game_id, ply, move AS top, conf AS top_conf, contains(move, 'a') AND t >= 0.4 AND conf <= 0.9 AS hit, regexp_replace(move, 'a([^a]*)$', 'g\\1') AS variant, t FROM a WHERE rk = 0),
o AS (SELECT game_id, ply, move, conf, rk FROM a JOIN p USING (game_id, ply) WHERE rk = 0 OR move <> top), v AS (SELECT game_id, ply, min(rk) AS rk FROM o JOIN p USING (game_id, ply) WHERE hit AND move = variant GROUP BY ALL),
u AS (SELECT o.game_id, o.ply, move, CASE WHEN v.rk IS NOT NULL THEN least(0.98::DOUBLE, conf + top_conf * (p.t * 0.6::DOUBLE)) ELSE conf END AS conf, o.rk AS rk FROM o JOIN p USING (game_id, ply) LEFT JOIN v ON v.game_id = o.game_id AND v.ply = o.ply AND v.rk = o.rk
  UNION ALL SELECT p.game_id, p.ply, variant, least(0.98::DOUBLE, top_conf * (p.t * 0.6::DOUBLE)), 99 FROM p LEFT JOIN v USING (game_id, ply) WHERE hit AND v.rk IS NULL)
SELECT u.game_id, u.ply, string_agg(move, ' ' ORDER BY CASE WHEN hit THEN -round(u.conf, 9) ELSE u.rk END, u.rk) AS moves, round(arg_min(u.conf, CASE WHEN hit THEN -round(u.conf, 9) ELSE u.rk END * 1000.0::DOUBLE + u.rk / 1e6), 6) AS top_conf FROM u JOIN p USING (game_id, ply) GROUP BY ALL""")
def rnk08_boost_variant(spark, sf_dir):
    """A reading with a doubtful a gains its g variant, by outside evidence t."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rk", "move", "conf"))), lambda x: F.struct(x["move"].alias("move"), x["conf"].alias("conf")))
    pools = cand(spark, sf_dir).where("sheet = 1").groupBy("game_id", "ply").agg(rows.alias("pool"))
    out = pools.select("game_id", "ply", E.boosted(F.col("pool"), (F.col("ply") % 10).cast("double") / 10).alias("pool"))
    return out.select("game_id", "ply", F.concat_ws(" ", F.transform("pool", lambda x: x["move"])).alias("moves"), F.round(F.col("pool")[0]["conf"], 6).alias("top_conf"))
