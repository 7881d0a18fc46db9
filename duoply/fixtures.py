"""Test views over the driver tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "orders", "customer", "lineitem", "embeddings")

VIEWS = {
    "candidates": """
WITH e AS (
  SELECT user_id AS game_id, event_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ply FROM events),
s AS (SELECT 1 AS sheet UNION ALL SELECT 2 AS sheet),
r AS (SELECT 0 AS rk UNION ALL SELECT 1 AS rk UNION ALL SELECT 2 AS rk),
x AS (SELECT e.game_id, s.sheet, e.ply, r.rk, e.event_id,
             CASE WHEN s.sheet = 1 OR e.event_id % 10 < 7 THEN e.event_id ELSE e.event_id * 5 + 1 END + r.rk * 11 AS k
      FROM e CROSS JOIN s CROSS JOIN r WHERE NOT (s.sheet = 2 AND e.event_id % 41 = 0))
SELECT game_id, sheet, ply, rk,
  CASE CAST(k % 4 AS INT) WHEN 0 THEN 'N' WHEN 1 THEN 'R' WHEN 2 THEN 'Q' ELSE '' END
    || CASE WHEN k % 5 = 0 THEN 'x' ELSE '' END
    || SUBSTR('abcdefgh', CAST((k * 3) % 8 AS INT) + 1, 1) || CAST((k * 7) % 8 + 1 AS STRING)
    || CASE WHEN k % 9 = 0 THEN '+' ELSE '' END AS move,
  CASE WHEN rk = 0 THEN 0.5 + CAST((k * 37) % 50 AS DOUBLE) / 100 ELSE CAST((k * 37) % 40 AS DOUBLE) / 100 END AS conf,
  (event_id % 23) <> 0 AS legal
FROM x
""",
    "pairings": """
SELECT o.o_orderkey AS pairing_id, 'S' || CAST(o.o_orderkey % 4 AS STRING) AS section,
  CAST(FLOOR(o.o_orderkey / 4.0) AS BIGINT) % 9 + 1 AS round,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(FLOOR(o.o_orderkey / 36.0) AS BIGINT) + 1 + 15 * (o.o_orderkey % 4) END AS board,
  o.o_custkey AS white_sno, (o.o_custkey * 7 + o.o_orderkey + 1) % 100 AS black_sno,
  w.c_name AS white_name, b.c_name AS black_name,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 0 ELSE CAST(FLOOR(w.c_acctbal / 10.0) AS BIGINT) + 1000 END AS white_rtg,
  CAST(FLOOR(b.c_acctbal / 10.0) AS BIGINT) + 1000 AS black_rtg,
  CASE o.o_orderstatus WHEN 'F' THEN '1 - 0' WHEN 'O' THEN '0-1' ELSE '½-½' END AS result_raw,
  o.o_orderdate AS played_at
FROM orders o JOIN customer w ON w.c_custkey = o.o_custkey
JOIN customer b ON b.c_custkey = (o.o_custkey * 7 + o.o_orderkey + 1) % 100
""",
    "files": """
SELECT o_orderkey AS file_id,
  CASE CAST(o_orderkey % 4 AS INT)
    WHEN 0 THEN 'Open/Round ' || CAST(o_orderkey % 9 + 1 AS STRING) || '/Board ' || CAST(CAST(FLOOR(o_orderkey / 72.0) AS BIGINT) + 1 AS STRING) || '/scan_p' || CAST(o_orderkey % 3 + 1 AS STRING) || '.pdf'
    WHEN 1 THEN 'Club/U1300/Rd ' || CAST(o_orderkey % 9 + 1 AS STRING) || '/Bd ' || CAST(CAST(FLOOR(o_orderkey / 72.0) AS BIGINT) + 1 AS STRING) || '/b' || CAST(CAST(FLOOR(o_orderkey / 72.0) AS BIGINT) + 1 AS STRING) || 'p1.jpg'
    WHEN 2 THEN 'OpenR' || CAST(o_orderkey % 9 + 1 AS STRING) || 'B' || CAST(CAST(FLOOR(o_orderkey / 72.0) AS BIGINT) + 1 AS STRING) || 'p2.JPG'
    ELSE 'IMG_' || CAST(o_orderkey AS STRING) || '.png' END AS path,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS modified_at
FROM orders
""",
    "fixes": """
SELECT l_orderkey % 2000 AS game_id,
  CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'greedy' WHEN 1 THEN 'beam' ELSE 'dijkstra' END AS method,
  CAST(l_linenumber * 2 + l_partkey % 2 AS BIGINT) AS ply,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'Nf' WHEN 1 THEN 'Rd' ELSE 'e' END || CAST(l_partkey % 4 + 1 AS STRING)
    || CASE WHEN l_partkey % 6 = 0 THEN '+' ELSE '' END AS san,
  CASE WHEN l_linenumber = 1 THEN 100.0 - l_quantity ELSE 1.0 - l_quantity / 100.0 END AS similarity,
  CASE l_returnflag WHEN 'A' THEN 'SOLVED' WHEN 'N' THEN 'VALID' ELSE 'PARTIAL' END AS status
FROM lineitem
""",
    "interactions": """
SELECT user_id AS operator_id, ts, event_type AS open_game, event_id FROM events
""",
    "decisions": """
SELECT event_id, user_id AS game_id,
  CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'keep' WHEN 'purchase' THEN 'override' ELSE 'edit' END AS action,
  SUBSTR('KQRBN', CAST(event_id % 5 AS INT) + 1, 1) AS ocr,
  SUBSTR('KQRBN', CAST((event_id * 3 + user_id) % 5 AS INT) + 1, 1) AS final_san, value AS t_sec
FROM events
""",
    "edits": """
SELECT user_id AS game_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS op,
  event_id % 20 AS pos, event_id, ts FROM events
""",
    "boxes": """
SELECT CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) AS sheet_id, l_linenumber AS col_hint,
  CAST(l_linenumber AS DOUBLE) / 8 + CAST(l_partkey % 7 AS DOUBLE) / 1000 AS x_frac, l_quantity / 60.0 AS y_frac FROM lineitem
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def oracle(views: str, sql: str) -> str:
    """DuckDB SQL: the named views as leading common table expressions of sql."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes} {sql}"
