"""Queries over candidate pools: merging, reliability, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoply import config as C
from duoply.fixtures import oracle, view
from duoply.functions import similarity as S
from duoply.functions.moves import normalize_move
from duoply.operators import detect as D
from duoply.operators import reconcile as J
from duoply.plans.columns import NORM, likeness_sql

QUERIES, ORACLES = {}, {}


def query(sql: str, views: str = "candidates"):
    """Registers a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(views, sql)
        return f

    return add


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "candidates")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


N = NORM.format("move")
#: Full moves of {cells} that the next one of the same sheet repeats, in DuckDB.
REPEATS = """WITH n AS (SELECT game_id, sheet, ply, rk, """ + N + """ AS norm, conf FROM {cells}), a AS (SELECT game_id, sheet, ply, norm, arg_max(conf, rk) AS a FROM n GROUP BY ALL),
o AS (SELECT a.game_id, a.sheet, a.ply, sum(a + conf) AS overlap FROM a JOIN n ON a.game_id = n.game_id AND a.sheet = n.sheet AND a.ply + 2 = n.ply AND a.norm = n.norm GROUP BY ALL),
m AS (SELECT game_id, sheet, ply, x.k AS k, x.v AS v, sum(conf) AS m FROM (SELECT *, unnest([{{'k': 'piece', 'v': CASE WHEN norm[1] IN ('K', 'Q', 'R', 'B', 'N') THEN norm[1] ELSE 'P' END}}, {{'k': 'file', 'v': norm[-2:-2]}}]) AS x FROM n) GROUP BY ALL),
b AS (SELECT x.game_id, x.sheet, x.ply, least(2.0::DOUBLE, sum(x.m + y.m) FILTER (x.k = 'piece')) AS piece, least(2.0::DOUBLE, sum(x.m + y.m) FILTER (x.k = 'file')) AS file FROM m x JOIN m y ON x.game_id = y.game_id AND x.sheet = y.sheet AND x.ply + 2 = y.ply AND x.k = y.k AND x.v = y.v GROUP BY ALL),
t AS (SELECT game_id, sheet, ply, norm AS top FROM n WHERE rk = 0 AND norm <> ''), p AS (SELECT t.game_id, t.sheet, t.ply, t.top = s.top AS same, coalesce(overlap, 0) AS overlap, piece, file FROM t JOIN t s ON t.game_id = s.game_id AND t.sheet = s.sheet AND t.ply + 2 = s.ply LEFT JOIN o ON o.game_id = t.game_id AND o.sheet = t.sheet AND o.ply = t.ply LEFT JOIN b ON b.game_id = t.game_id AND b.sheet = t.sheet AND b.ply = t.ply)
SELECT w.game_id, w.sheet, w.ply AS at, CASE WHEN k.same THEN 'exact' ELSE 'structured' END AS kind, round(w.overlap, 6) AS white, round(k.overlap, 6) AS black FROM p w JOIN p k ON w.game_id = k.game_id AND w.sheet = k.sheet AND w.ply + 1 = k.ply
WHERE w.ply % 2 = 0 AND w.same AND round(w.overlap, 9) >= 0.6 AND ((k.same AND round(k.overlap, 9) >= 0.3) OR (NOT k.same AND round(k.piece, 9) >= 1.6 AND round(k.file, 9) >= 1.6))"""
CONF = "coalesce(nullif(conf, 0.0::DOUBLE), 0.1::DOUBLE)"
SUP = f"""sup0 AS (SELECT game_id, ply, sheet, {N} AS norm, arg_min(conf, rk) AS conf FROM candidates GROUP BY ALL),
sup AS (SELECT game_id, ply, norm, least(sum(conf), 1.5::DOUBLE) AS support, min(conf) AS least, count(*) AS sheets FROM sup0 GROUP BY ALL),
t AS (SELECT coalesce(a.game_id, b.game_id) AS game_id, coalesce(a.ply, b.ply) AS ply, a.move AS m1, a.conf AS c1, b.move AS m2, b.conf AS c2, {NORM.format('a.move')} AS n1, {NORM.format('b.move')} AS n2,
  (a.move IS NOT NULL)::INT + (b.move IS NOT NULL)::INT AS sheet_count
  FROM (SELECT * FROM candidates WHERE sheet = 1 AND rk = 0) a FULL JOIN (SELECT * FROM candidates WHERE sheet = 2 AND rk = 0) b ON a.game_id = b.game_id AND a.ply = b.ply),
rel AS (SELECT g.game_id, coalesce(n, 0) AS n, coalesce(rate, 1.0::DOUBLE) AS rate, coalesce(n >= 8 AND rate < 0.4, false) AS unreliable FROM (SELECT DISTINCT game_id FROM candidates) g
  LEFT JOIN (SELECT game_id, count(*) AS n, avg((n1 = n2)::INT) AS rate FROM t WHERE sheet_count = 2 GROUP BY game_id) USING (game_id))"""
MERGED = f"""{SUP},
u AS (SELECT t.*, sheet_count = 2 AND n1 = n2 AS agree, s1.support AS s1, s2.support AS s2 FROM t LEFT JOIN sup s1 ON s1.game_id = t.game_id AND s1.ply = t.ply AND s1.norm = t.n1 LEFT JOIN sup s2 ON s2.game_id = t.game_id AND s2.ply = t.ply AND s2.norm = t.n2),
p AS (SELECT *, CASE WHEN agree THEN n1 WHEN m2 IS NULL THEN m1 WHEN m1 IS NULL THEN m2 WHEN round(s1, 9) >= round(s2, 9) THEN m1 ELSE m2 END AS pick,
  CASE WHEN agree OR m2 IS NULL THEN s1 WHEN m1 IS NULL THEN s2 WHEN round(s1, 9) >= round(s2, 9) THEN s1 ELSE s2 END AS pick_support FROM u),
pool AS (SELECT game_id, ply, norm, least(sum(conf), 1.5::DOUBLE) AS conf, min(seen) AS seen FROM (
  SELECT game_id, ply, {N} AS norm, {CONF} AS conf, sheet * 1000 + rk AS seen FROM candidates WHERE rk > 0
  UNION ALL SELECT game_id, ply, CASE WHEN c1 >= c2 THEN n2 ELSE n1 END, CASE WHEN c1 >= c2 THEN c2 ELSE c1 END, CASE WHEN c1 >= c2 THEN 1999 ELSE 2999 END FROM p WHERE sheet_count = 2 AND NOT agree) GROUP BY ALL),
best AS (SELECT game_id, ply, norm AS alt, conf AS alt_conf FROM pool QUALIFY row_number() OVER (PARTITION BY game_id, ply ORDER BY round(conf, 9) DESC, seen) = 1),
w AS (SELECT p.*, alt, alt_conf, coalesce(sheet_count = 2 AND round(alt_conf, 9) > round(pick_support, 9), false) AS promoted FROM p LEFT JOIN best USING (game_id, ply)),
f AS (SELECT *, CASE WHEN promoted THEN alt ELSE pick END AS move, CASE WHEN promoted THEN alt_conf WHEN agree THEN least(c1 + c2 * 0.5::DOUBLE, 1.5::DOUBLE) WHEN sheet_count = 1 THEN coalesce(c1, c2) ELSE pick_support END AS conf,
  coalesce(n1[1] = 'Q' AND n2[1] = 'Q' AND n1[-2:] <> n2[-2:], false) AS clash FROM w),
merged AS (SELECT f.game_id, f.ply, f.move, f.conf, f.sheet_count, f.agree, f.promoted,
  coalesce(sheet_count = 2 AND NOT agree AND ({NORM.format('f.move')} IN (n1, n2)) AND ((round(abs(s1 - s2), 9) < 0.15 AND greatest(c1, c2) >= 0.45 AND (NOT unreliable OR clash)) OR (clash AND least(s1, s2) >= 0.45)), false) AS ambiguous,
  coalesce(sheet_count = 2 AND (agree OR (z.sheets = 2 AND z.least >= 0.15 AND round(z.support, 9) >= 1.0)), false) AS consensus
  FROM f JOIN rel USING (game_id) LEFT JOIN sup z ON z.game_id = f.game_id AND z.ply = f.ply AND z.norm = {NORM.format('f.move')})"""


@query(f"WITH {MERGED} SELECT game_id, ply, move, round(conf, 6) AS conf, CAST(sheet_count AS INTEGER) AS sheet_count, agree, promoted, ambiguous, consensus FROM merged")
def jn01_merge_two_readings(spark, sf_dir):
    return rounded(J.merge(cand(spark, sf_dir)), "conf")


@query(f"SELECT game_id, ply, norm, round(conf, 6) AS conf, sources, CAST(row_number() OVER (PARTITION BY game_id, ply ORDER BY round(conf, 9) DESC, seen) AS INTEGER) AS place FROM (SELECT game_id, ply, {N} AS norm, least(sum({CONF}), 1.5::DOUBLE) AS conf, string_agg(DISTINCT sheet::VARCHAR, ',' ORDER BY sheet::VARCHAR) AS sources, min(sheet * 1000 + rk) AS seen FROM candidates WHERE rk > 0 GROUP BY ALL)")
def jn02_pool_alternatives(spark, sf_dir):
    return rounded(J.pool(J.alternatives(cand(spark, sf_dir))), "conf")


@query(f"SELECT game_id, ply, sheet, {N} AS norm, arg_min(conf, rk) AS conf FROM candidates GROUP BY ALL")
def jn03_support_for_move(spark, sf_dir):
    return J.support(cand(spark, sf_dir))


OVERLAP = f"""a AS (SELECT game_id, ply, {N} AS norm, arg_max(conf, rk) AS a FROM candidates WHERE sheet = 1 GROUP BY ALL), b AS (SELECT game_id, ply, {N} AS norm, conf AS b FROM candidates WHERE sheet = 2),
o AS (SELECT game_id, ply, sum(a + b) AS overlap FROM a JOIN b USING (game_id, ply, norm) GROUP BY ALL), every AS (SELECT DISTINCT game_id, ply FROM candidates), scores AS (SELECT game_id, ply, coalesce(overlap, 0.0::DOUBLE) AS overlap FROM every LEFT JOIN o USING (game_id, ply))"""


@query(f"WITH {OVERLAP} SELECT game_id, ply, round(overlap, 6) AS overlap FROM o")
def jn04_pool_overlap(spark, sf_dir):
    return rounded(J.overlap(cand(spark, sf_dir)), "overlap")


@query(f"""WITH p AS (SELECT game_id, ply, sheet, conf, unnest([{{'k': 'target', 'v': regexp_extract({N}, '[a-h][1-8]$')}}, {{'k': 'rank', 'v': ({N})[-1:]}}, {{'k': 'file', 'v': ({N})[-2:-2]}}, {{'k': 'piece', 'v': CASE WHEN move[1] IN ('N', 'R', 'Q') THEN move[1] ELSE 'P' END}}, {{'k': 'move', 'v': {N}}}]) AS x FROM candidates),
q AS (SELECT game_id, ply, sheet, x.k AS k, x.v AS v, sum(conf) AS m FROM p GROUP BY ALL), s AS (SELECT a.game_id, a.ply, a.k, least(sum(a.m + b.m), 2.0::DOUBLE) AS mass FROM q a JOIN q b ON a.sheet = 1 AND b.sheet = 2 AND a.game_id = b.game_id AND a.ply = b.ply AND a.k = b.k AND a.v = b.v GROUP BY ALL)
SELECT game_id, ply, round(sum(mass * CASE k WHEN 'target' THEN 0.4::DOUBLE WHEN 'rank' THEN 0.3::DOUBLE WHEN 'file' THEN 0.1::DOUBLE WHEN 'piece' THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END), 6) AS score FROM s GROUP BY ALL""")
def jn05_structured_overlap(spark, sf_dir):
    return rounded(J.structured_overlap(cand(spark, sf_dir)), "score")


def shifted(spark, sf_dir):
    """Candidates whose second sheet is two moves late in every third game."""
    late = F.when((F.col("sheet") == 2) & (F.col("game_id") % 3 == 0), F.col("ply") + 4).otherwise(F.col("ply"))
    return cand(spark, sf_dir).withColumn("ply", late)


@query(f"""WITH t AS (SELECT game_id, sheet, (ply + CASE WHEN sheet = 2 AND game_id % 3 = 0 THEN 4 ELSE 0 END) AS p, {N} AS norm FROM candidates WHERE rk = 0), k AS (SELECT game_id, count_if(sheet = 1) AS k1, count_if(sheet = 2) AS k2 FROM t GROUP BY ALL),
h AS (SELECT a.game_id, o.o AS shift, count(*) AS agreements FROM t a CROSS JOIN (SELECT unnest(range(-5, 6)) AS o) o JOIN t b ON a.sheet = 1 AND b.sheet = 2 AND a.game_id = b.game_id AND a.p + 2 * o.o = b.p AND a.norm = b.norm GROUP BY ALL),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY agreements DESC, shift) = 1)
SELECT r.game_id, CAST(r.shift AS INTEGER) AS shift, r.agreements, round(r.agreements::DOUBLE / k1, 6) AS rate FROM r JOIN k USING (game_id) LEFT JOIN h z ON z.game_id = r.game_id AND z.shift = 0
WHERE k1 >= 5 AND k2 >= 5 AND r.shift <> 0 AND r.agreements >= 5 AND r.agreements::DOUBLE / k1 > coalesce(z.agreements, 0)::DOUBLE / k1 + 0.2""")
def jn06_detect_shift(spark, sf_dir):
    return rounded(J.detect_shift(shifted(spark, sf_dir)), "rate")


@query(f"WITH {SUP} SELECT game_id, n, round(rate, 6) AS rate, unreliable FROM rel")
def agg01_reader_reliability(spark, sf_dir):
    return rounded(J.reliability(cand(spark, sf_dir)), "rate")


@query(f"WITH {MERGED} SELECT game_id, count_if(agree)::BIGINT AS agree, count_if(sheet_count = 1)::BIGINT AS one_sheet, count_if(sheet_count = 2 AND NOT agree)::BIGINT AS disagree, count(*) AS total FROM merged GROUP BY ALL")
def agg02_agreement_summary(spark, sf_dir):
    m = J.merge(cand(spark, sf_dir)).where("move <> ''")
    return m.groupBy("game_id").agg(F.count_if("agree").alias("agree"), F.count_if(F.col("sheet_count") == 1).alias("one_sheet"), F.count_if((F.col("sheet_count") == 2) & ~F.col("agree")).alias("disagree"), F.count("*").alias("total"))


def tiers(spark, sf_dir) -> DataFrame:
    c = cand(spark, sf_dir)
    legal = c.groupBy("game_id", "ply").agg(F.bool_and("legal").alias("legal"))
    return D.classify_tiers(J.merge(c).join(legal, ["game_id", "ply"]))


TIERS = f"""{MERGED}, lg AS (SELECT game_id, ply, bool_and(legal) AS legal FROM candidates GROUP BY ALL),
tier AS (SELECT game_id, ply, CASE WHEN max((ambiguous OR NOT legal)::INT) OVER (PARTITION BY game_id ORDER BY ply) = 1 THEN 3 WHEN sheet_count = 2 AND (agree OR consensus) THEN 1 ELSE 2 END AS tier FROM merged JOIN lg USING (game_id, ply))"""


@query(f"WITH {TIERS} SELECT game_id, count_if(tier = 1)::BIGINT AS tier1, count_if(tier = 2)::BIGINT AS tier2, count_if(tier = 3)::BIGINT AS tier3, count(*) AS total FROM tier GROUP BY ALL")
def agg03_tier_summary(spark, sf_dir):
    one = lambda k: F.count_if(F.col("tier") == k).alias(f"tier{k}")
    return tiers(spark, sf_dir).groupBy("game_id").agg(one(1), one(2), one(3), F.count("*").alias("total"))


@query(f"WITH {TIERS} SELECT game_id, ply, CAST(tier AS INTEGER) AS tier FROM tier")
def win09_classify_tiers(spark, sf_dir):
    return tiers(spark, sf_dir)


@query(f"WITH {TIERS} SELECT 'tier1' AS mode, game_id, count_if(tier = 1) AS n, max(ply) FILTER (tier = 1) AS last FROM tier GROUP BY game_id HAVING n > 0 UNION ALL SELECT 'tier1+2', game_id, count_if(tier < 3), max(ply) FILTER (tier < 3) FROM tier GROUP BY game_id HAVING count_if(tier < 3) > 0")
def win09_locked_plies(spark, sf_dir):
    t = tiers(spark, sf_dir)
    of = lambda mode: D.locked_plies(t, mode).groupBy(F.lit(mode).alias("mode"), "game_id").agg(F.count("*").alias("n"), F.max("ply").alias("last"))
    return of("none").union(of("tier1")).union(of("tier1+2"))


def scores(spark, sf_dir) -> DataFrame:
    """Overlap of every ply of a game, 0 where nothing is shared."""
    c = cand(spark, sf_dir)
    return c.select("game_id", "ply").distinct().join(J.overlap(c), ["game_id", "ply"], "left").fillna(0.0, ["overlap"])


@query(f"WITH {OVERLAP}, w AS (SELECT game_id, ply, row_number() OVER q - 1 AS i, avg(overlap) OVER (q ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m, count(*) OVER (q ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM scores WINDOW q AS (PARTITION BY game_id ORDER BY ply)) SELECT game_id, min(ply) AS start FROM w WHERE n = 8 AND i % 2 = 0 AND m < 1.2 GROUP BY ALL")
def win05_overlap_drop(spark, sf_dir):
    return D.overlap_drop(scores(spark, sf_dir), below=1.2, digits=None)  # its SQL compares the mean as it is


@query(f"""WITH {OVERLAP}, s AS (SELECT game_id, ply, least(overlap * 4, 2.0::DOUBLE) AS overlap FROM scores), l AS (SELECT *, overlap < 0.25 AS low, CASE WHEN count(*) OVER b = 4 THEN min(overlap) OVER b END AS before, CASE WHEN count(*) OVER a = 4 THEN min(overlap) OVER a END AS after FROM s
  WINDOW b AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
g AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ply) - row_number() OVER (PARTITION BY game_id, low ORDER BY ply) AS isle FROM l), r AS (SELECT game_id, isle, min(ply) AS start, count(*) AS n, arg_min(before, ply) AS before, arg_max(after, ply) AS after FROM g WHERE low GROUP BY ALL)
SELECT game_id, min(start) AS start FROM r WHERE n BETWEEN 2 AND 6 AND before >= 0.9 AND after >= 0.9 GROUP BY ALL""")
def win06_isolated_dropout(spark, sf_dir):
    return D.isolated_dropout(scores(spark, sf_dir).withColumn("overlap", F.least(F.col("overlap") * 4, F.lit(2.0))))


@query(f"""WITH {SUP}, d AS (SELECT game_id, ply, n1 <> n2 AS off, CASE WHEN n1 = n2 OR n1 = '' OR n2 = '' THEN 0.0::DOUBLE ELSE levenshtein(n1, n2)::DOUBLE / greatest(length(n1), length(n2)) END AS ratio FROM t WHERE sheet_count = 2),
g AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ply) - row_number() OVER (PARTITION BY game_id, off ORDER BY ply) AS isle FROM d),
r AS (SELECT game_id, isle, min(ply) AS start, count(*) AS n, count_if(ratio >= 0.4)::BIGINT AS strong, round(avg(ratio), 6) AS mean_ratio FROM g WHERE off GROUP BY ALL)
SELECT game_id, start, n, strong, mean_ratio, CASE WHEN strong >= 10 THEN 'high' WHEN strong >= 5 THEN 'medium' ELSE 'low' END AS level FROM r WHERE n >= 4 AND strong >= 3""")
def win07_disagreement_runs(spark, sf_dir):
    return rounded(D.disagreement_runs(J.tops(cand(spark, sf_dir))), "mean_ratio")


TOPS = "tp AS (SELECT game_id, sheet, ply, move, conf, legal FROM candidates WHERE rk = 0)"


def top_rows(spark, sf_dir) -> DataFrame:
    return cand(spark, sf_dir).where("rk = 0").drop("rk")


@query(f"WITH {TOPS}, b AS (SELECT game_id, sheet, min(ply) FILTER (NOT legal) AS bad FROM tp GROUP BY ALL) SELECT game_id, sheet, ply, move FROM tp JOIN b USING (game_id, sheet) WHERE bad IS NULL OR ply < bad")
def win08_valid_prefix(spark, sf_dir):
    return D.valid_prefix(top_rows(spark, sf_dir)).select("game_id", "sheet", "ply", "move")


def noisy(spark, sf_dir) -> DataFrame:
    """Readings whose last plies are weak or repeat, in turn by game."""
    t = top_rows(spark, sf_dir)
    last = F.max("ply").over(D.Window.partitionBy("game_id", "sheet")) - F.col("ply")
    t = t.withColumn("last", last).withColumn("kind", (F.col("game_id") + F.col("sheet")) % 4)
    weak = (F.col("kind") == 0) & (F.col("last") < 6)
    return t.withColumns({"conf": F.when(weak, F.col("conf") * 0.3).otherwise(F.col("conf")), "move": F.when((F.col("kind") == 1) & (F.col("last") < 5), "Nf3").when((F.col("kind") == 2) & (F.col("last") < 8), F.when(F.col("ply") % 2 == 0, "f4").otherwise("e5")).otherwise(F.col("move"))}).drop("last", "kind")


NOISY = f"{TOPS}, n0 AS (SELECT *, max(ply) OVER (PARTITION BY game_id, sheet) - ply AS last, (game_id + sheet) % 4 AS kind FROM tp), noisy AS (SELECT game_id, sheet, ply, CASE WHEN kind = 1 AND last < 5 THEN 'Nf3' WHEN kind = 2 AND last < 8 THEN CASE WHEN ply % 2 = 0 THEN 'f4' ELSE 'e5' END ELSE move END AS move, CASE WHEN kind = 0 AND last < 6 THEN conf * 0.3::DOUBLE ELSE conf END AS conf FROM n0)"


def simple_noise(rows: str) -> str:
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY game_id, sheet ORDER BY ply DESC) AS back FROM {rows}), s AS (SELECT game_id, sheet, max(ply) FILTER (conf >= 0.4) AS strong FROM b GROUP BY ALL),
k AS (SELECT game_id, sheet, count_if(strong IS NULL OR ply > strong) AS trail, min(ply) FILTER (strong IS NULL OR ply > strong) AS ts, avg(conf) FILTER (back <= 4) AS m4, count(*) AS n FROM b JOIN s USING (game_id, sheet) GROUP BY ALL),
o AS (SELECT game_id, sheet, min(ply) AS first FROM b WHERE back <= 6 GROUP BY game_id, sheet, move HAVING count(*) >= 4),
r AS (SELECT game_id, sheet, CASE WHEN trail >= 4 THEN ts WHEN first IS NOT NULL THEN first WHEN n >= 4 AND round(m4, 9) < 0.35 AND trail >= 3 THEN ts END AS start FROM k LEFT JOIN o USING (game_id, sheet))"""


@query(f"WITH {NOISY}, {simple_noise('noisy')} SELECT * FROM r WHERE start IS NOT NULL")
def win02_tail_noise_simple(spark, sf_dir):
    return D.simple_tail_noise(noisy(spark, sf_dir))


@query(f"""WITH {NOISY}, i AS (SELECT *, row_number() OVER (PARTITION BY game_id, sheet ORDER BY ply) - 1 AS i, count(*) OVER (PARTITION BY game_id, sheet) AS n, lag(move, 2) OVER (PARTITION BY game_id, sheet ORDER BY ply) AS bf FROM noisy),
p AS (SELECT game_id, sheet, i // 2 AS pair, min(coalesce(move = bf, false)::INT) AS same FROM i WHERE n % 2 = 0 OR i < n - 1 GROUP BY ALL), g AS (SELECT game_id, sheet, max(pair) FILTER (same = 0) AS kept FROM p GROUP BY ALL)
SELECT game_id, sheet, ply, move FROM i JOIN g USING (game_id, sheet) WHERE i // 2 <= kept OR (n % 2 = 1 AND i = n - 1)""")
def win03_trim_repeated_pairs(spark, sf_dir):
    return D.trim_repeated_pairs(noisy(spark, sf_dir))


def tail(rows: str) -> str:
    """SQL of tail noise over rows (game_id, sheet, ply, move, conf, locked)."""
    return f"""n1 AS (SELECT *, row_number() OVER d AS back, count(*) OVER g AS n, coalesce(lead(move) OVER u, lag(move) OVER u) AS beside, CASE WHEN regexp_matches(move, '[x+#=]|^[O0]-') THEN 2 ELSE 0 END AS hard FROM {rows} WINDOW d AS (PARTITION BY game_id, sheet ORDER BY ply DESC), u AS (PARTITION BY game_id, sheet ORDER BY ply), g AS (PARTITION BY game_id, sheet)),
nr AS (SELECT game_id, sheet, count(DISTINCT ply // 2) AS full_rows FROM n1 GROUP BY ALL), n2 AS (SELECT *, NOT locked AND (conf < CASE WHEN hard < 2 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END OR (hard < 2 AND move = beside)) AS bad FROM n1 JOIN nr USING (game_id, sheet)),
n3 AS (SELECT *, count_if(NOT bad) OVER (PARTITION BY game_id, sheet ORDER BY back ROWS 3 PRECEDING) = 4 AND back >= 4 AS good FROM n2), n4 AS (SELECT *, bool_or(good) OVER (PARTITION BY game_id, sheet ORDER BY back ROWS UNBOUNDED PRECEDING) AS ended FROM n3),
da AS (SELECT game_id, sheet, min(ply) AS start FROM n4 WHERE NOT ended AND bad AND n >= 4 AND full_rows >= 3 GROUP BY ALL HAVING count(*) >= 3 AND count(*) * 2 >= max(back)),
n5 AS (SELECT *, bool_or(locked OR move <> tail_move) OVER (PARTITION BY game_id, sheet ORDER BY back ROWS UNBOUNDED PRECEDING) AS differs FROM (SELECT *, first_value(move) OVER (PARTITION BY game_id, sheet ORDER BY back) AS tail_move FROM n2)),
db AS (SELECT game_id, sheet, min(ply) AS start FROM n5 WHERE NOT differs AND full_rows >= 2 GROUP BY ALL HAVING count(*) >= 3),
n6 AS (SELECT *, ply % 2 AS half, bool_or(locked OR NOT regexp_matches(move, '^[a-h][1-8][+#]?$')) OVER (PARTITION BY game_id, sheet, ply % 2 ORDER BY back ROWS UNBOUNDED PRECEDING) AS other FROM n2 WHERE full_rows >= 4),
dc AS (SELECT game_id, sheet, min(ply) AS start FROM n6 WHERE NOT other GROUP BY game_id, sheet, half HAVING count(*) >= 3 AND count(DISTINCT regexp_replace(move, '[+#]$', '')) < count(*)),
n7 AS (SELECT game_id, sheet, max(CASE WHEN locked THEN 1.0::DOUBLE ELSE conf END) FILTER (back = 1) AS l1, max(CASE WHEN locked THEN 1.0::DOUBLE ELSE conf END) FILTER (back = 2) AS l2, max(ply) AS p1, min(ply) AS p2 FROM n2 WHERE back <= 2 AND n >= 4 AND full_rows >= 3 GROUP BY ALL),
dd AS (SELECT game_id, sheet, CASE WHEN l1 < 0.55 AND l2 < 0.55 THEN p2 WHEN l1 < 0.5 THEN p1 END AS start FROM n7), tn AS (SELECT game_id, sheet, min(start) AS start FROM (SELECT * FROM da UNION ALL SELECT * FROM db UNION ALL SELECT * FROM dc UNION ALL SELECT * FROM dd) WHERE start IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {NOISY}, nl AS (SELECT *, ply % 17 = 5 AS locked FROM noisy), {tail('nl')} SELECT * FROM tn")
def win01_tail_noise(spark, sf_dir):
    return D.tail_noise(noisy(spark, sf_dir).withColumn("locked", F.col("ply") % 17 == 5))


@query("""WITH j AS (SELECT sheet_id, x_frac, coalesce((x_frac - lag(x_frac) OVER (PARTITION BY sheet_id ORDER BY x_frac) > 0.02)::INT, 0) AS j FROM boxes), k AS (SELECT *, sum(j) OVER (PARTITION BY sheet_id ORDER BY x_frac) AS c FROM j)
SELECT sheet_id, CAST(c AS BIGINT) AS cluster, count(*) AS n, round(median(x_frac), 6) AS centre FROM k GROUP BY ALL HAVING count(*) >= 4""", "boxes")
def win10_gap_clusters_1d(spark, sf_dir):
    return rounded(D.clusters_1d(view(spark, sf_dir, "boxes"), ("sheet_id",), "x_frac", 0.02), "centre")


@query(f"""WITH {TOPS}, m AS (SELECT game_id, sheet, ply, ply % 2 AS h, conf, CASE WHEN move[1] = 'x' THEN translate(move[2], 'abcdefgh', 'badcfehg') || move ELSE move END AS move FROM tp),
w AS (SELECT *, move[1] AS source, regexp_extract(move, '([a-h][1-8])[+#]?$', 1) AS target, contains(move, 'x') AS takes FROM m WHERE regexp_matches(move, '^[a-h]')),
f AS (SELECT *, first_value(ply) OVER q AS anchor_ply, first_value(conf) OVER q AS anchor_conf FROM w WINDOW q AS (PARTITION BY game_id, sheet, h, source, target ORDER BY ply))
SELECT game_id, sheet, ply, anchor_ply, CASE WHEN anchor_conf < conf THEN anchor_ply ELSE ply END AS suspect_ply FROM f
WHERE ply > anchor_ply AND NOT EXISTS (SELECT 1 FROM w c WHERE c.game_id = f.game_id AND c.sheet = f.sheet AND c.h = f.h AND c.takes AND c.target[1] = f.source AND c.ply < f.ply)""")
def win11_repeated_pawn_targets(spark, sf_dir):
    """Pawn captures are written with the file next to their target."""
    move = F.when(F.col("move").startswith("x"), F.concat(F.translate(F.substring("move", 2, 1), "abcdefgh", "badcfehg"), F.col("move"))).otherwise(F.col("move"))
    return D.repeated_pawn_targets(top_rows(spark, sf_dir).withColumn("move", move))


@query(f"WITH {TOPS}, b AS (SELECT game_id, sheet, min(ply) FILTER (NOT legal) AS bad FROM tp GROUP BY ALL) SELECT game_id, sheet, ply FROM tp JOIN b USING (game_id, sheet) WHERE (bad IS NULL OR ply < bad) AND contains(move, '+') AND ply % 3 <> 0")
def win12_flag_mismatch(spark, sf_dir):
    return D.flag_mismatch(top_rows(spark, sf_dir).withColumn("gives_check", F.col("ply") % 3 == 0), "gives_check")


@query("""SELECT open_game, round(sum(gap), 6) AS seconds FROM (SELECT open_game, (epoch_us(lead(ts) OVER (PARTITION BY operator_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM interactions) WHERE gap > 0 AND gap <= 7200 GROUP BY ALL""", "interactions")
def win14_attention_time(spark, sf_dir):
    return rounded(D.attention(view(spark, sf_dir, "interactions"), seconds=7200), "seconds")


@query(f"WITH {SUP} SELECT game_id, ply, n1 AS norm FROM t WHERE sheet_count = 2 AND n1 = n2 AND n1 <> ''")
def set02_agreement_set(spark, sf_dir):
    c = J.normed(cand(spark, sf_dir).where("rk = 0")).where("norm <> ''")
    a, b = (c.where(F.col("sheet") == s).select("game_id", "ply", "norm") for s in (1, 2))
    return a.intersect(b)


@query(f"WITH {SUP} SELECT game_id, ply FROM t WHERE ply % 3 = 0 AND NOT coalesce(sheet_count = 2 AND n1 = n2, false)")
def set03_user_confirmed(spark, sf_dir):
    locked = cand(spark, sf_dir).where("rk = 0 and ply % 3 = 0").select("game_id", "ply").distinct()
    return locked.exceptAll(set02_agreement_set(spark, sf_dir).select("game_id", "ply").where("ply % 3 = 0"))


@query("""WITH base AS (SELECT game_id, ply, move, conf FROM candidates WHERE sheet = 1 AND rk = 0), other AS (SELECT game_id, ply, move, conf FROM candidates WHERE sheet = 2 AND rk = 0)
SELECT b.game_id, b.ply, CASE WHEN b.ply % 9 = 0 THEN coalesce(o.move, '???') ELSE b.move END AS move, CASE WHEN b.ply % 9 = 0 THEN coalesce(o.conf, 0.0::DOUBLE) ELSE b.conf END AS conf FROM base b LEFT JOIN other o USING (game_id, ply)""")
def jn13_backfill_placeholders(spark, sf_dir):
    c = cand(spark, sf_dir).where("rk = 0")
    hole = F.col("ply") % 9 == 0
    base = c.where("sheet = 1").select("game_id", "ply", F.when(hole, "???").otherwise(F.col("move")).alias("move"), F.when(hole, 0.0).otherwise(F.col("conf")).alias("conf"))
    other = c.where("sheet = 2 and move <> '???'").select("game_id", "ply", F.col("move").alias("m"), F.col("conf").alias("k"))
    empty = F.col("move") == "???"
    return base.join(other, ["game_id", "ply"], "left").select("game_id", "ply", F.when(empty, F.coalesce("m", "move")).otherwise(F.col("move")).alias("move"), F.when(empty, F.coalesce("k", "conf")).otherwise(F.col("conf")).alias("conf"))


PIECE = "CASE WHEN {0}[1] IN ('K', 'Q', 'R', 'B', 'N') THEN {0}[1] ELSE 'P' END"


@query(f"""WITH t AS (SELECT game_id, ply, rk, move, conf, regexp_extract(move, '[a-h][1-8]') AS x, {PIECE.format('move')} AS kind FROM candidates WHERE sheet = 1), f AS (SELECT * FROM t WHERE rk = 0 AND x <> ''),
go AS (SELECT f.game_id, f.ply, min(l.ply) AS ply2, arg_min(l.x, l.ply) AS x2 FROM f JOIN f l ON l.game_id = f.game_id AND l.ply > f.ply AND l.ply % 2 = f.ply % 2 AND l.kind = f.kind GROUP BY ALL),
nm AS (SELECT game_id, ply, x, arg_min(move, rk) AS text FROM t WHERE x <> '' AND (rk = 0 OR conf >= 0.5) GROUP BY ALL), rf AS (SELECT f.game_id, f.ply, min(n.ply) AS ply2, arg_min(n.text, n.ply) AS text FROM f JOIN nm n ON n.game_id = f.game_id AND n.ply > f.ply AND n.x = f.x GROUP BY ALL),
j AS (SELECT f.*, go.ply2 AS gp, go.x2 AS gx, rf.ply2 AS rp, rf.text AS text, coalesce(go.x2 <> f.x AND go.ply2 <= coalesce(rf.ply2, go.ply2), false) AS leaves, abs(ascii(f.x) - ascii(go.x2)) AS df, abs(f.x[2]::INT - go.x2[2]::INT) AS dr FROM f LEFT JOIN go ON go.game_id = f.game_id AND go.ply = f.ply LEFT JOIN rf ON rf.game_id = f.game_id AND rf.ply = f.ply)
SELECT game_id, ply, CASE WHEN leaves THEN gp ELSE rp END AS later_ply, CASE WHEN leaves THEN 'leaves' WHEN rp % 2 <> ply % 2 AND contains(text, 'x') THEN 'captured' WHEN rp % 2 = ply % 2 AND NOT contains(text, 'x') AND {PIECE.format('text')} = kind THEN 'returns' ELSE 'other' END AS event,
CASE WHEN leaves THEN CASE WHEN (kind IN ('B', 'Q') AND df = dr AND df > 0) OR (kind IN ('R', 'Q') AND (df = 0) <> (dr = 0)) THEN 4 ELSE 0 END WHEN rp % 2 <> ply % 2 AND contains(text, 'x') THEN 8 WHEN rp % 2 = ply % 2 AND NOT contains(text, 'x') AND {PIECE.format('text')} = kind THEN -4 ELSE 0 END AS bonus FROM j WHERE leaves OR rp IS NOT NULL""")
def jn15_first_future_reference(spark, sf_dir):
    return J.future_reference(cand(spark, sf_dir).where("sheet = 1"))


@query(f"""WITH c AS (SELECT game_id, ply, ply % 2 AS half, {PIECE.format('m')} AS kind, CASE WHEN m[1] = 'B' THEN CASE WHEN (ascii(rtrim(m, '+#')[-2:]) - 97 + rtrim(m, '+#')[-1:]::INT - 1) % 2 = 1 THEN 'light' ELSE 'dark' END ELSE '' END AS shade, conf FROM (SELECT game_id, ply, conf, CASE WHEN game_id % 2 = 0 THEN replace(move, 'N', 'B') ELSE move END AS m FROM candidates WHERE sheet = 1 AND rk = 0))
SELECT a.game_id, a.ply, coalesce(count_if(b.conf >= 0.7), 0)::BIGINT AS later, min(b.ply) FILTER (b.conf >= 0.7) AS next_ply, coalesce(string_agg(b.ply::VARCHAR, ',' ORDER BY b.ply) FILTER (b.conf >= 0.85), '') AS surest FROM c a LEFT JOIN c b ON a.game_id = b.game_id AND a.half = b.half AND a.kind = b.kind AND a.shade = b.shade AND b.ply > a.ply GROUP BY ALL""")
def jn16_future_piece_moves(spark, sf_dir):
    """Later sure readings of the same piece and colour, bishops by the shade of their squares."""
    move = F.when(F.col("game_id") % 2 == 0, F.replace("move", F.lit("N"), F.lit("B"))).otherwise(F.col("move"))
    found = J.future_piece_moves(cand(spark, sf_dir).where("sheet = 1 and rk = 0").withColumn("move", move))
    return found.withColumn("surest", F.concat_ws(",", F.transform("surest", lambda p: p.cast("string"))))


@query(f"""WITH nm AS (SELECT {N} AS move, count(*) AS n FROM candidates WHERE rk = 0 AND conf > 0.8 GROUP BY ALL), prior AS (SELECT move[-2:] AS position_key, move, round(ln(n::DOUBLE / sum(n) OVER (PARTITION BY move[-2:])), 6) AS logp FROM nm)
SELECT c.game_id, c.sheet, c.ply, c.rk, coalesce(p.logp, round(ln(1e-4::DOUBLE), 6)) AS logp FROM candidates c LEFT JOIN prior p ON p.position_key = {NORM.format('c.move')}[-2:] AND p.move = {NORM.format('c.move')}""")
def jn17_prior_lookup(spark, sf_dir):
    c = J.normed(cand(spark, sf_dir)).withColumn("position_key", F.substring("norm", -2, 2))
    n = c.where("rk = 0 and conf > 0.8").groupBy("position_key", "norm").count()
    prior = n.withColumn("logp", F.round(F.log(F.col("count") / F.sum("count").over(D.Window.partitionBy("position_key"))), 6))
    return c.join(prior, ["position_key", "norm"], "left").select("game_id", "sheet", "ply", "rk", F.coalesce("logp", F.round(F.log(F.lit(1e-4)), 6)).alias("logp"))


def counted(name: str, most: str = "") -> str:
    return f"SELECT game_id, ply, string_agg({name} || ':' || n, ',' ORDER BY n DESC, rk) AS v FROM (SELECT game_id, ply, {name}, count(*) AS n, min(rk) AS rk FROM t WHERE {name} <> '' GROUP BY ALL {most}) GROUP BY ALL"


@query(f"""WITH t AS (SELECT game_id, ply, rk, move, regexp_extract(move, '^[KQRBN]') AS p, regexp_extract(move, '[a-h][1-8]') AS x FROM candidates WHERE sheet = 1), pc AS ({counted('p')}), ds AS ({counted('x')}), p2 AS (SELECT game_id, ply, p, count(*) AS n, min(rk) AS rk FROM t WHERE p <> '' GROUP BY game_id, ply, p QUALIFY row_number() OVER (PARTITION BY game_id, ply ORDER BY count(*) DESC, min(rk)) <= 2),
tp AS (SELECT game_id, ply, string_agg(p || ':' || n, ',' ORDER BY n DESC, rk) AS v FROM p2 GROUP BY ALL), s AS (SELECT game_id, ply, count_if(contains(move, 'x'))::BIGINT AS captures, round(avg(contains(move, 'x')::INT), 6) AS capture_ratio, round(avg((p <> '')::INT), 6) AS piece_ratio FROM t GROUP BY ALL)
SELECT s.*, coalesce(pc.v, '') AS pieces, coalesce(ds.v, '') AS destinations, coalesce(tp.v, '') AS top_pieces FROM s LEFT JOIN pc USING (game_id, ply) LEFT JOIN ds USING (game_id, ply) LEFT JOIN tp USING (game_id, ply)""")
def agg06_candidate_profile(spark, sf_dir):
    return rounded(J.candidate_profile(cand(spark, sf_dir).where("sheet = 1")), "capture_ratio", "piece_ratio")


@query("SELECT game_id, ply % 2 AS half, move[1] AS piece, count(*) AS n, min(ply) AS first_ply, string_agg(ply::VARCHAR, ',' ORDER BY ply) AS plies FROM candidates WHERE sheet = 1 AND rk = 0 AND conf >= 0.9 AND move[1] IN ('Q', 'R', 'B', 'N') GROUP BY ALL HAVING count(*) >= 2")
def agg07_piece_clusters(spark, sf_dir):
    c = cand(spark, sf_dir).where("sheet = 1 and rk = 0 and conf >= 0.9").withColumn("piece", F.substring("move", 1, 1)).where(F.col("piece").isin("Q", "R", "B", "N"))
    plies = F.array_join(F.transform(F.array_sort(F.collect_list("ply")), lambda p: p.cast("string")), ",")
    return c.groupBy("game_id", (F.col("ply") % 2).alias("half"), "piece").agg(F.count("*").alias("n"), F.min("ply").alias("first_ply"), plies.alias("plies")).where("n >= 2")


@query(f"WITH {NOISY}, nl AS (SELECT *, false AS locked FROM noisy), {tail('nl')} SELECT game_id, d - CASE WHEN game_id IN (SELECT game_id FROM tn) THEN 1000 ELSE 0 END AS difficulty FROM (SELECT game_id, count_if(coalesce(conf, 1) < 0.8)::BIGINT AS d FROM nl GROUP BY game_id)")
def agg08_difficulty(spark, sf_dir):
    t = noisy(spark, sf_dir)
    noise = D.tail_noise(t).select("game_id").distinct().withColumn("noisy", F.lit(1000))
    score = t.groupBy("game_id").agg(F.count_if(F.coalesce("conf", F.lit(1.0)) < 0.8).alias("difficulty"))
    return score.join(noise, "game_id", "left").select("game_id", (F.col("difficulty") - F.coalesce("noisy", F.lit(0))).alias("difficulty"))


@query(f"""WITH {TOPS}, m AS (SELECT game_id, max(n) AS plies FROM (SELECT game_id, sheet, count(*) AS n FROM tp WHERE game_id % 7 <> 3 GROUP BY ALL) GROUP BY ALL), c AS (SELECT game_id, count(*) AS cells FROM tp GROUP BY ALL), b AS (SELECT game_id, min(ply) FILTER (NOT legal) AS bad FROM tp WHERE sheet = 1 GROUP BY ALL),
k AS (SELECT b.game_id, count(*) FILTER (bad IS NULL OR ply < bad) AS confirmed FROM b JOIN tp ON tp.game_id = b.game_id AND tp.sheet = 1 GROUP BY ALL), l AS (SELECT game_id, coalesce(plies, CAST(ceil(cells / 2.0) AS BIGINT)) AS plies, confirmed FROM c LEFT JOIN m USING (game_id) JOIN k USING (game_id))
SELECT game_id, plies, CAST(ceil(plies / 2.0) AS BIGINT) AS moves, CASE WHEN game_id % 4 = 0 THEN CAST(ceil(plies / 2.0) AS BIGINT) || '/' || CAST(ceil(plies / 2.0) AS BIGINT) WHEN confirmed > 0 THEN CAST(ceil(confirmed / 2.0) AS BIGINT) || '/' || CAST(ceil(plies / 2.0) AS BIGINT) ELSE CAST(ceil(plies / 2.0) AS BIGINT)::VARCHAR END AS progress FROM l""")
def agg18_length_progress(spark, sf_dir):
    """Sheets of every seventh game aren't loaded (their cells are known), every fourth game is verified."""
    t = top_rows(spark, sf_dir)
    games = t.groupBy("game_id").agg(F.count("*").alias("cells")).withColumn("verified", F.col("game_id") % 4 == 0)
    confirmed = D.valid_prefix(t.where("sheet = 1")).groupBy("game_id").agg(F.count("*").alias("confirmed"))
    return D.length_progress(t.where("game_id % 7 <> 3"), games, confirmed)


@query("WITH m AS (SELECT game_id, count_if(sheet = 1) AS a, count_if(sheet = 2 AND ply < 20) AS b FROM candidates WHERE rk = 0 GROUP BY ALL) SELECT game_id, a // 2 >= 12 AND b // 2 > 0 AND (b // 2) * 2 < a // 2 AND a // 2 - b // 2 > 8 AS poisoned FROM m")
def agg19_length_sanity(spark, sf_dir):
    t = top_rows(spark, sf_dir).groupBy("game_id").agg(F.floor(F.count_if(F.col("sheet") == 1) / 2).alias("expected"), F.floor(F.count_if((F.col("sheet") == 2) & (F.col("ply") < 20)) / 2).alias("rows"))
    return t.select("game_id", ((F.col("expected") >= 12) & (F.col("rows") > 0) & (F.col("rows") * 2 < F.col("expected")) & (F.col("expected") - F.col("rows") > 8)).alias("poisoned"))


def page_cells(spark, sf_dir) -> DataFrame:
    """Cells by number and colour; numbers begin anew on every page in each fourth game's second sheet, and some confidences are missing."""
    clamped = (F.col("game_id") % 4 == 1) & (F.col("sheet") == 2)
    num = F.when(clamped, F.floor(F.col("ply") / 2) % 10 + 1).otherwise(F.floor(F.col("ply") / 2) + 1)
    return top_rows(spark, sf_dir).select("game_id", "sheet", F.col("ply").alias("pos"), num.alias("num"), F.when(F.col("ply") % 2 == 0, "w").otherwise("b").alias("color"), "move", F.when(F.col("ply") % 9 != 4, F.col("conf")).alias("conf"))


PAIRED = f"""{TOPS}, pc AS (SELECT game_id, sheet, ply AS pos, CASE WHEN game_id % 4 = 1 AND sheet = 2 THEN ply // 2 % 10 + 1 ELSE ply // 2 + 1 END AS num, ply % 2 AS half, move, CASE WHEN ply % 9 <> 4 THEN conf ELSE 0.9::DOUBLE END AS conf FROM tp),
tw AS (SELECT DISTINCT game_id, sheet FROM pc GROUP BY game_id, sheet, num, half HAVING count(*) > 1), op AS (SELECT pc.*, tw.game_id IS NOT NULL AS twice, sum((half = 0 OR coalesce(before, 1) <> 0)::INT) OVER (PARTITION BY pc.game_id, pc.sheet ORDER BY pos) AS line FROM (SELECT *, lag(half) OVER (PARTITION BY game_id, sheet ORDER BY pos) AS before FROM pc) pc LEFT JOIN tw USING (game_id, sheet)),
pm AS (SELECT game_id, sheet, CAST(CASE WHEN twice THEN line ELSE num END AS BIGINT) AS num, coalesce(max(move) FILTER (half = 0), '') AS white, coalesce(max(move) FILTER (half = 1), '') AS black, coalesce(max(conf) FILTER (half = 0), 0.9::DOUBLE) AS white_conf, coalesce(max(conf) FILTER (half = 1), 0.9::DOUBLE) AS black_conf FROM op GROUP BY ALL)"""


@query(f"WITH {PAIRED} SELECT * FROM pm")
def agg22_pair_and_flatten(spark, sf_dir):
    return J.paired_moves(page_cells(spark, sf_dir))


@query(f"WITH {PAIRED} SELECT game_id, sheet, row_number() OVER (PARTITION BY game_id, sheet ORDER BY num, half) - 1 AS i, move, conf FROM (SELECT game_id, sheet, num, 0 AS half, white AS move, white_conf AS conf FROM pm UNION ALL SELECT game_id, sheet, num, 1, black, black_conf FROM pm) WHERE move <> ''")
def agg22_flat_moves(spark, sf_dir):
    return J.flat_moves(J.paired_moves(page_cells(spark, sf_dir)))


@query(f"""WITH pr AS (SELECT c.game_id, c.ply, s.move AS b, c.move AS a, c.conf, c.rk FROM candidates c JOIN candidates s ON c.game_id = s.game_id AND c.ply = s.ply AND c.sheet = 2 AND s.sheet = 1 AND s.rk = 0), {likeness_sql('pr')},
e AS (SELECT pr.*, sim, conf >= 0.5 AS seen FROM pr JOIN sim ON pr.a = sim.a AND pr.b = sim.b)
SELECT game_id, ply, round(CASE WHEN bool_or(seen) THEN max(sim) FILTER (seen) ELSE max(sim) FILTER (rk = 0) END, 6) AS similarity, CASE WHEN bool_or(seen) THEN CASE WHEN max(sim) FILTER (seen) > 0 THEN arg_min(a, -round(sim, 9) * 1000 + rk / 1000.0) FILTER (seen) ELSE arg_min(a, rk) FILTER (seen) END ELSE arg_min(a, rk) END AS text FROM e GROUP BY ALL""")
def rnk06_best_of_n_similarity(spark, sf_dir):
    c = cand(spark, sf_dir)
    moves = c.where("sheet = 1 and rk = 0").select("game_id", "ply", F.col("move").alias("candidate"))
    return rounded(S.best_of(moves, c.where("sheet = 2").select("game_id", "ply", "rk", F.col("move").alias("text"), "conf"), ["game_id", "ply"], C.SEEN_CONF), "similarity")
