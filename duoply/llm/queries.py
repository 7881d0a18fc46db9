"""One query for each operator, over whole tables, with the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoply.llm import ann, backoff, bytepairs, hardneg, langid, linededup, mixing, packing, resample, simhash, token_count, topk, toxicity
from duoply.llm.common import held_out, tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(langid.learnable(docs).select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.each_row(mixing.plan_mix(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(table(spark, sf_dir, "embeddings"), label=moved)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_learned_partitions, op3_token_count, op4_best_fit_packing, op5_simhash_dedup, op6_bit_sliced_topk, op7_stupid_backoff, op8_toxicity, op9_source_mix, op10_line_dedup,
        op11_byte_pairs, op12_importance_resampling, op13_hard_negatives,
    )
}

ORACLES = {
    "op6_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS stripped
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keyed AS (SELECT doc_id, i, l, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeats AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT d.doc_id, d.i, d.l, r.k IS NOT NULL AND d.doc_id <> r.keeper AS gone FROM keyed d LEFT JOIN repeats r ON d.k = r.k AND length(d.k) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_importance_resampling": r"""
WITH RECURSIVE crc(k, turn, v) AS (
  SELECT k, 0, k::UINTEGER FROM range(256) t(k)
  UNION ALL SELECT k, turn + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM crc WHERE turn < 8),
lookup AS (SELECT list(v ORDER BY k) AS t FROM crc WHERE turn = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS i, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
cut AS (SELECT side, i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, i, unnest(w) AS g FROM cut UNION ALL SELECT side, i, w[j] || ' ' || w[j + 1] FROM (SELECT side, i, w, unnest(range(1, len(w))) AS j FROM cut)),
counted AS (SELECT side, i, g, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(0, octet_length(encode(g))::BIGINT), lambda p: ('0x' || substr(hex(encode(g)), 2 * p::BIGINT + 1, 2))::UINTEGER)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER) % 10000 AS b
  FROM (SELECT DISTINCT g FROM counted), lookup),
sums AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM counted JOIN hashed USING (g) GROUP BY b),
every AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT b, floor(1000 * ln((sums.t + 1) * (every.s + 10000) / ((sums.s + 1) * (every.t + 10000))))::BIGINT AS gain FROM sums, every),
doc AS (SELECT i, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN hashed USING (g) JOIN gain USING (b) WHERE side = 0 GROUP BY i),
noise AS (SELECT i, doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM texts WHERE side = 0),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM noise LEFT JOIN doc USING (i)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS place, count_if(n_features >= 39) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND place <= 25 * n // 100 THEN place END AS rank FROM drawn""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS mate, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE mate QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.mate AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
