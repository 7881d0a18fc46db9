"""Column functions over move text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoply.config import CONFUSABLE, NEUTRAL_SIMILARITY

#: Forms of a move text (format of the notation).
PLAIN = r"^([KQRBN])?([a-h])?([1-8])?(x)?([a-h])([1-8])(?:=?([QRBN]))?$"
LENIENT_PAWN = r"^P(x)?([a-h])([1-8])$"
FILE_CAPTURE = r"^([a-h])x?([a-h])$"


def normalize_move(m: Column) -> Column:
    """Without + and #, trimmed, castling with letters; null gives the empty text."""
    bare = F.trim(F.regexp_replace(F.coalesce(m, F.lit("")), "[+#]", ""))
    return F.replace(F.replace(bare, F.lit("0-0-0"), F.lit("O-O-O")), F.lit("0-0"), F.lit("O-O"))


def parse_move(m: Column) -> Column:
    """struct(piece, target, file, rank, capture, promo, castle), or null."""
    s = normalize_move(m)
    part = lambda i: F.nullif(F.regexp_extract(s, PLAIN, i), F.lit(""))

    def made(piece, file, rank, capture, promo, castle) -> Column:
        text = [x.cast("string") for x in (piece, F.concat(file, rank), file, rank)]
        return F.struct(*(x.alias(n) for x, n in zip([*text, capture, promo.cast("string"), castle.cast("string")], ("piece", "target", "file", "rank", "capture", "promo", "castle"))))

    none = F.lit(None)
    castle = made(F.lit("K"), none, none, F.lit(False), none, s)
    plain = made(F.coalesce(part(1), F.lit("P")), part(5), part(6), F.length(F.regexp_extract(s, PLAIN, 4)) > 0, part(7), none)
    pawn = made(F.lit("P"), F.regexp_extract(s, LENIENT_PAWN, 2), F.regexp_extract(s, LENIENT_PAWN, 3), F.length(F.regexp_extract(s, LENIENT_PAWN, 1)) > 0, none, none)
    files = made(F.lit("P"), F.regexp_extract(s, FILE_CAPTURE, 2), none, F.lit(True), none, none)
    return F.when(s.isin("O-O", "O-O-O"), castle).when(s.rlike(PLAIN), plain).when(s.rlike(LENIENT_PAWN), pawn).when(s.rlike(FILE_CAPTURE), files)


def is_truncated(m: Column) -> Column:
    """Null, blank, placeholder or not a move."""
    return m.isNull() | (F.trim(m) == "") | (m == "???") | parse_move(m).isNull()


def notation_class(m: Column) -> Column:
    """Name of the notation a text is written in."""
    s = F.trim(F.regexp_replace(F.coalesce(m, F.lit("")), "[+#]$", ""))
    near = F.abs(F.ascii(F.substring(s, 1, 1)) - F.ascii(F.substring(F.replace(s, F.lit("x")), 2, 1))) == 1
    rules = [  # fixed values: forms and their names
        (s.rlike("^O-O(-O)?$"), "castling"), (s.rlike("^0-0(-0)?$"), "zero_castling"), (s.rlike("^([a-h]x)?[a-h][18]=[QRBN]$"), "promotion"),
        (s.rlike("^([KQRBN][a-h]?[1-8]?x?[a-h][1-8]|([a-h]x)?[a-h][1-8])$"), "standard"), (s.rlike("^[KQRBN]?[a-h][1-8]-[a-h][1-8]$"), "dash"), (s.rlike("^[a-h][1-8][a-h][1-8]$"), "long"),
        (s.rlike("^Px?[a-h][1-8]$"), "pawn_prefix"), (s.rlike("^[a-h]x?[a-h]$") & near, "file_capture"), (s.rlike("^[KQRBN]x[KQRBNP]$"), "piece_takes_piece"),
        (s.rlike("^[KQRBN]x[KQRBNP][a-h][1-8]$"), "piece_takes_piece_on_square"), (s.rlike("^[a-h][1-8]x[a-h][1-8]$"), "square_takes_square"),
    ]
    out = F.lit("invalid")
    for rule, name in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def ply_of(num: Column, color: Column) -> Column:
    return ((num - 1) * 2 + F.when(F.lower(color).isin("w", "white"), 0).otherwise(1)).cast("long")


def ply_label(ply: Column) -> Column:
    return F.concat((F.floor(ply / 2) + 1).cast("long").cast("string"), F.when(ply % 2 == 0, ".W").otherwise(".B"))


def label_ply(label: Column) -> Column:
    num = F.regexp_extract(label, r"(?i)^(\d+)\.([WB])$", 1)
    return F.when(num != "", ply_of(num.cast("long"), F.regexp_extract(label, r"(?i)^(\d+)\.([WB])$", 2)))


def disagreement(a: Column, b: Column) -> Column:
    """Edit distance of normalised texts over the longer length; 0 if equal or one is blank."""
    x, y = normalize_move(a), normalize_move(b)
    return F.when((x == y) | (x == "") | (y == ""), 0.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def _ends(m: Column, sign: str) -> Column:
    return F.coalesce(m, F.lit("")).contains(sign)


def count_changes(a: Column, b: Column) -> Column:
    """Differences in piece, destination file and rank, capture, check, mate."""
    p, q = parse_move(a), parse_move(b)
    parts = [~p[f].eqNullSafe(q[f]) for f in ("piece", "file", "rank", "capture")] + [_ends(a, s) != _ends(b, s) for s in "+#"]
    return sum((x.cast("int") for x in parts), F.lit(0))


def semantic_changes(a: Column, b: Column) -> Column:
    """Reasons why replacing a by b needs to be confirmed."""
    p, q = parse_move(a), parse_move(b)
    when = lambda rule, name: F.when(rule, F.lit(name))
    return F.array_compact(F.array(
        when(_ends(a, "+") & ~_ends(b, "+") & ~_ends(b, "#"), "check_removed"), when(_ends(a, "#") & ~_ends(b, "#"), "mate_removed"),
        when(p["capture"] & ~q["capture"], "capture_removed"), when(p["piece"] != q["piece"], "piece_changed"),
    ))


def is_safe(a: Column, b: Column, most: int = 2) -> Column:
    p, q = parse_move(a), parse_move(b)
    few = count_changes(a, b) <= most
    known = p["target"].isNotNull() & q["target"].isNotNull()
    return F.when(known, few & ~((p["file"] != q["file"]) & (p["rank"] != q["rank"]))).otherwise(few)


def complexity(m: Column) -> Column:
    """0 simple pawn move, 1 piece or two-file pawn move, 2 capture, check, castling or promotion."""
    s = F.coalesce(m, F.lit(""))
    return F.when(s.rlike("[x+#=]|^[O0]-"), 2).when(s.rlike("^[KQRBN]|^[a-h][a-h1-8][a-h]"), 1).otherwise(0)


def effective_similarity(a: Column, b: Column, similarity: Column) -> Column:
    """The similarity, or a neutral value where exactly one side is castling."""
    castles = lambda m: normalize_move(m).isin("O-O", "O-O-O")
    return F.when(castles(a) != castles(b), NEUTRAL_SIMILARITY).otherwise(similarity)


def confusable(m: Column) -> Column:
    """Array of the move with its piece replaced by each one it is mistaken for."""
    out = []
    for a, b in CONFUSABLE:
        for x, y in ((a, b), (b, a)):
            out.append(F.when(F.substring(m, 1, 1) == x, F.concat(F.lit(y), F.substring(m, 2, 100))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))


def checksum(lines: Column) -> Column:
    """FNV-1a, 32 bits, as eight hex digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    h = F.aggregate(F.split(lines, ""), F.lit(2166136261).cast("long"), step)
    return F.lpad(F.lower(F.hex(h)), 8, "0")
