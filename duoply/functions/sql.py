"""SQL names of the column functions, as SQL functions that call each other: scalars, structs, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from duoply.functions.moves import FILE_CAPTURE, LENIENT_PAWN, PLAIN
from duoply.functions.similarity import ALIKE

ALIKE_SQL = "map(" + ", ".join(f"'{k}', {v}D" for k, v in ALIKE.items()) + ")"
MOVE = "STRUCT<piece: STRING, target: STRING, file: STRING, rank: STRING, capture: BOOLEAN, promo: STRING, castle: STRING>"

def _made(piece: str, file: str, rank: str, capture: str, promo: str, castle: str) -> str:
    return f"named_struct('piece', {piece}, 'target', concat({file}, {rank}), 'file', {file}, 'rank', {rank}, 'capture', {capture}, 'promo', {promo}, 'castle', {castle})"


def _part(pattern: str, i: int) -> str:
    return f"nullif(regexp_extract(s, r'{pattern}', {i}), '')"


def _like(x: str, y: str) -> str:
    """Likeness of two symbols, as text: SQL functions can't be called for the elements of an array."""
    return f"CASE WHEN {x} = {y} THEN 1.0D ELSE coalesce(try_element_at({ALIKE_SQL}, {x} || {y}), try_element_at({ALIKE_SQL}, {y} || {x}), CASE WHEN lower({x}) = lower({y}) THEN 0.9D ELSE 0.1D END) END"


def _beside(x: str, y: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (g, h) -> CASE WHEN g IS NULL OR h IS NULL THEN 0.0D ELSE {_like('g', 'h')} END), 0.0D, (total, w) -> total + w)"


def _file(square: str) -> str:
    return f"substring({square}, 1, 1)"


def _rank(square: str) -> str:
    return f"substring({square}, 2, 1)"


ORIGINS = f"CASE WHEN u IS NOT NULL AND v IS NOT NULL AND u <> v THEN 0.5D + 0.5D * ({_like('u', 'v')}) ELSE 1.0D END"
LONGER, SHORTER = ("CASE WHEN length(o) > length(c) THEN split({}, '') ELSE split({}, '') END".format(*x) for x in (("o", "c"), ("c", "o")))


#: (name and arguments, type, body), each after those that it calls. Patterns are those of functions.moves.
FUNCTIONS = [
    ("normalize_move(m STRING)", "STRING", "replace(replace(trim(regexp_replace(coalesce(m, ''), '[+#]', '')), '0-0-0', 'O-O-O'), '0-0', 'O-O')"),
    ("parse_normalized(s STRING)", MOVE, f"""CASE
      WHEN s IN ('O-O', 'O-O-O') THEN {_made("'K'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "false", "CAST(NULL AS STRING)", "s")}
      WHEN s RLIKE r'{PLAIN}' THEN {_made(f"coalesce({_part(PLAIN, 1)}, 'P')", _part(PLAIN, 5), _part(PLAIN, 6), f"{_part(PLAIN, 4)} IS NOT NULL", _part(PLAIN, 7), "CAST(NULL AS STRING)")}
      WHEN s RLIKE r'{LENIENT_PAWN}' THEN {_made("'P'", _part(LENIENT_PAWN, 2), _part(LENIENT_PAWN, 3), f"{_part(LENIENT_PAWN, 1)} IS NOT NULL", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")}
      WHEN s RLIKE r'{FILE_CAPTURE}' THEN {_made("'P'", _part(FILE_CAPTURE, 2), "CAST(NULL AS STRING)", "true", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")} END"""),
    ("parse_move(m STRING)", MOVE, "parse_normalized(normalize_move(m))"),
    ("move_target(m STRING)", "STRING", "nullif(regexp_extract(m, '([a-h][1-8])(?:=?[QRBN])?[+#]*$', 1), '')"),
    ("is_truncated(m STRING)", "BOOLEAN", "m IS NULL OR trim(m) = '' OR m = '???' OR parse_move(m) IS NULL"),
    ("notation_of(s STRING)", "STRING", """CASE WHEN s RLIKE '^O-O(-O)?$' THEN 'castling' WHEN s RLIKE '^0-0(-0)?$' THEN 'zero_castling' WHEN s RLIKE '^([a-h]x)?[a-h][18]=[QRBN]$' THEN 'promotion'
      WHEN s RLIKE '^([KQRBN][a-h]?[1-8]?x?[a-h][1-8]|([a-h]x)?[a-h][1-8])$' THEN 'standard' WHEN s RLIKE '^[KQRBN]?[a-h][1-8]-[a-h][1-8]$' THEN 'dash' WHEN s RLIKE '^[a-h][1-8][a-h][1-8]$' THEN 'long'
      WHEN s RLIKE '^Px?[a-h][1-8]$' THEN 'pawn_prefix' WHEN s RLIKE '^[a-h]x?[a-h]$' AND abs(ascii(substring(s, 1, 1)) - ascii(substring(replace(s, 'x'), 2, 1))) = 1 THEN 'file_capture'
      WHEN s RLIKE '^[KQRBN]x[KQRBNP]$' THEN 'piece_takes_piece' WHEN s RLIKE '^[KQRBN]x[KQRBNP][a-h][1-8]$' THEN 'piece_takes_piece_on_square' WHEN s RLIKE '^[a-h][1-8]x[a-h][1-8]$' THEN 'square_takes_square' ELSE 'invalid' END"""),
    ("notation_class(m STRING)", "STRING", "notation_of(trim(regexp_replace(coalesce(m, ''), '[+#]$', '')))"),
    ("ply_of(num BIGINT, color STRING)", "BIGINT", "(num - 1) * 2 + CASE WHEN lower(color) IN ('w', 'white') THEN 0 ELSE 1 END"),
    ("ply_label(ply BIGINT)", "STRING", "concat(CAST(floor(ply / 2) + 1 AS STRING), CASE WHEN ply % 2 = 0 THEN '.W' ELSE '.B' END)"),
    ("label_ply(label STRING)", "BIGINT", r"CASE WHEN label RLIKE r'(?i)^(\d+)\.([WB])$' THEN ply_of(try_cast(regexp_extract(label, r'(?i)^(\d+)\.([WB])$', 1) AS BIGINT), regexp_extract(label, r'(?i)^(\d+)\.([WB])$', 2)) END"),
    ("move_complexity(m STRING)", "INT", "CASE WHEN coalesce(m, '') RLIKE '[x+#=]|^[O0]-' THEN 2 WHEN coalesce(m, '') RLIKE '^[KQRBN]|^[a-h][a-h1-8][a-h]' THEN 1 ELSE 0 END"),
    ("move_changes(x STRING, y STRING, p " + MOVE + ", q " + MOVE + ")", "INT", "CAST(NOT p.piece <=> q.piece AS INT) + CAST(NOT p.file <=> q.file AS INT) + CAST(NOT p.rank <=> q.rank AS INT) + CAST(NOT p.capture <=> q.capture AS INT) + CAST(contains(x, '+') <> contains(y, '+') AS INT) + CAST(contains(x, '#') <> contains(y, '#') AS INT)"),
    ("count_changes(a STRING, b STRING)", "INT", "move_changes(coalesce(a, ''), coalesce(b, ''), parse_move(a), parse_move(b))"),
    ("text_disagreement(x STRING, y STRING)", "DOUBLE", "CASE WHEN x = y OR x = '' OR y = '' THEN 0.0D ELSE levenshtein(x, y) / greatest(length(x), length(y)) END"),
    ("move_disagreement(a STRING, b STRING)", "DOUBLE", "text_disagreement(normalize_move(a), normalize_move(b))"),
    ("normalized_result(s STRING)", "STRING", "CASE WHEN s IN ('1/2', '=', '1/2-') THEN '1/2-1/2' WHEN s = '' THEN '*' ELSE s END"),
    ("normalize_result(r STRING)", "STRING", r"normalized_result(replace(regexp_replace(coalesce(r, ''), r'\s+', ''), '½', '1/2'))"),
    ("person_key(name STRING)", "STRING", r"regexp_replace(lower(trim(coalesce(name, ''))), r'\s+', ' ')"),
    ("pair_key(a STRING, b STRING)", "STRING", "concat_ws('|', least(person_key(a), person_key(b)), greatest(person_key(a), person_key(b)))"),
    ("likeness(a STRING, b STRING)", "DOUBLE", _like("a", "b")),
    ("characters_alike(o STRING, c STRING)", "DOUBLE", f"""(CASE WHEN abs(length(o) - length(c)) = 1 THEN greatest({_beside("split(o, '')", "split(c, '')")},
      array_max(transform(sequence(1, greatest(length(o), length(c))), i -> {_beside(f"concat(slice({LONGER}, 1, i - 1), slice({LONGER}, i + 1, greatest(length(o), length(c))))", SHORTER)})))
      ELSE {_beside("split(o, '')", "split(c, '')")} END) / nullif(greatest(length(o), length(c)), 0)"""),
    ("piece_letter(m STRING)", "STRING", "CASE WHEN substring(m, 1, 1) IN ('K', 'Q', 'R', 'B', 'N') THEN substring(m, 1, 1) ELSE 'P' END"),
    ("last_square(m STRING)", "STRING", "nullif(regexp_extract(translate(m, 'x', ''), '([a-h][1-8])$', 1), '')"),
    ("origin_of(m STRING)", "STRING", "CASE WHEN length(translate(m, 'x', '')) >= 4 AND substring(translate(m, 'x', ''), 2, 1) RLIKE '[a-h1-8]' THEN substring(translate(m, 'x', ''), 2, 1) END"),
    ("weighed_alike(p STRING, q STRING, s STRING, t STRING, plain DOUBLE)", "DOUBLE", f"""CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN plain * 0.4D + (({_like(_file("s"), _file("t"))}) + ({_like(_rank("s"), _rank("t"))})) / 2 * 0.6D ELSE plain END"""),
    ("raised_alike(p STRING, q STRING, weighed DOUBLE)", "DOUBLE", "CASE WHEN p = q AND p <> 'P' THEN greatest(weighed, 0.35D) WHEN p <> q AND p <> 'P' AND q <> 'P' THEN weighed * 0.7D ELSE weighed END"),
    ("rank_alike(p STRING, u STRING, v STRING, base DOUBLE)", "DOUBLE", f"CASE WHEN p <> 'P' AND u IS NOT NULL AND v IS NOT NULL THEN CASE WHEN u = v THEN base + 0.05D ELSE base * ({ORIGINS}) END ELSE base END"),
    ("base_alike(o STRING, c STRING, p STRING, q STRING, s STRING, t STRING, u STRING, v STRING, loss DOUBLE)", "DOUBLE", f"""CASE WHEN o = c THEN 1.0D
      WHEN s = t THEN greatest(0.1D, (CASE WHEN p = q THEN 0.98D - CASE WHEN p <> 'P' AND (u IS NULL) <> (v IS NULL) THEN 0.12D ELSE 0.0D END ELSE CASE WHEN p <> 'P' AND q <> 'P' THEN 0.80D ELSE 0.70D END + 0.15D * ({_like("p", "q")}) END) - loss)
      WHEN p = q AND {_file("s")} = {_file("t")} THEN greatest(0.1D, (0.85D + 0.15D * ({_like(_rank("s"), _rank("t"))})) * ({ORIGINS}) - loss)
      WHEN p = q AND {_rank("s")} = {_rank("t")} THEN greatest(0.1D, rank_alike(p, u, v, 0.75D + 0.20D * ({_like(_file("s"), _file("t"))})) - loss)
      ELSE raised_alike(p, q, weighed_alike(p, q, s, t, characters_alike(o, c))) - loss END"""),
    ("marked_alike(a STRING, b STRING, base DOUBLE)", "DOUBLE", """base + CASE WHEN contains(a, 'x') THEN CASE WHEN contains(b, 'x') THEN 0.08D ELSE -0.06D END WHEN contains(b, 'x') THEN -0.03D ELSE 0.0D END
      + CASE WHEN contains(a, '+') THEN CASE WHEN contains(b, '+') THEN 0.25D ELSE -0.15D END ELSE 0.0D END + CASE WHEN contains(a, '#') THEN CASE WHEN contains(b, '#') THEN 0.30D ELSE -0.20D END ELSE 0.0D END"""),
    ("castled_alike(o STRING, c STRING, raised STRING, found DOUBLE)", "DOUBLE", """CASE WHEN o = c THEN found WHEN (raised IN ('O-O', 'OO') AND c = 'O-O') OR (raised IN ('O-O-O', 'OOO') AND c = 'O-O-O') THEN 1.0D
      WHEN contains(raised, 'O') OR c IN ('O-O', 'O-O-O') OR o = '' OR c = '' THEN 0.1D ELSE found END"""),
    ("bare_alike(a STRING, b STRING, o STRING, c STRING)", "DOUBLE", """castled_alike(o, c, translate(upper(o), '0', 'O'), least(CASE WHEN o = c THEN 1.0D ELSE 0.98D END, greatest(0.0D,
      marked_alike(a, b, base_alike(o, c, piece_letter(o), piece_letter(c), last_square(o), last_square(c), origin_of(o), origin_of(c), CASE WHEN abs(length(o) - length(c)) >= 2 THEN 0.15D * abs(length(o) - length(c)) ELSE 0.0D END)))))"""),
    ("move_similarity(a STRING, b STRING)", "DOUBLE", "bare_alike(coalesce(a, ''), coalesce(b, ''), regexp_replace(coalesce(a, ''), '[+#]+$', ''), regexp_replace(coalesce(b, ''), '[+#]+$', ''))"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql: FUNCTIONS, and moves_from_text for LATERAL."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION moves_from_text(game STRING) RETURNS TABLE (ply INT, move STRING)
      RETURN SELECT pos, col FROM (SELECT posexplode(filter(split(trim(regexp_replace(coalesce(game, ''), r'\{[^}]*\}|\[[^\]]*\]|\d+\.+', ' ')), r'\s+'), m -> m NOT IN ('', '*', '1-0', '0-1', '1/2-1/2'))))""")
