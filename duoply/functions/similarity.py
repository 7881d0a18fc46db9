"""How likely one move text is a reading of another: column functions, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoply.functions.moves import normalize_move, parse_move

#: Percent of a look-alike pair in the positional measure.
LOOK_ALIKE = {
    "ga": 80, "ag": 80, "43": 70, "34": 70, "5s": 70, "s5": 70, "6G": 60, "G6": 60, "6b": 60, "b6": 60, "RK": 75, "KR": 75, "BR": 65, "RB": 65, "BK": 60, "KB": 60,
    "O0": 90, "0O": 90, "Kh": 55, "hK": 55, "Bb": 55, "bB": 55, "17": 60, "71": 60, "27": 55, "72": 55, "38": 55, "83": 55, "45": 50, "54": 50,
}
#: Likeness of symbols that handwriting mixes up, in either order, for the structured measure.
ALIKE = {
    "KR": 0.6, "KN": 0.4, "RB": 0.5, "RP": 0.3, "BD": 0.5, "NH": 0.5, "NM": 0.4, "NB": 0.6, "QO": 0.5, "QG": 0.4,
    "ad": 0.6, "ao": 0.5, "ae": 0.4, "ag": 0.8, "bd": 0.6, "bh": 0.5, "ce": 0.7, "co": 0.4, "cd": 0.5, "dh": 0.7, "ef": 0.5, "gq": 0.6, "hn": 0.4, "cf": 0.4, "dg": 0.5,
    "17": 0.5, "1l": 0.6, "15": 0.4, "14": 0.4, "12": 0.3, "13": 0.4, "16": 0.5, "18": 0.3, "27": 0.6, "2z": 0.4, "26": 0.6, "24": 0.4, "25": 0.5, "28": 0.3, "38": 0.5, "35": 0.6, "36": 0.5, "34": 0.6,
    "37": 0.3, "49": 0.4, "45": 0.3, "46": 0.3, "47": 0.3, "48": 0.2, "56": 0.6, "5s": 0.4, "57": 0.2, "58": 0.3, "68": 0.5, "6b": 0.4, "67": 0.2, "78": 0.2, "8B": 0.3, "23": 0.5,
    "xX": 0.95, "O0": 0.95, "QC": 0.5, "cQ": 0.5, "xQ": 0.3, "Qd": 0.4, "BP": 0.4, "BQ": 0.2, "Kh": 0.6, "Bb": 0.7,
}


def _map(pairs: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def positional(a: Column, b: Column) -> Column:
    """0-100: equal characters, a bonus for look-alikes, a penalty for length."""
    n, m = F.length(a), F.length(b)
    short, long = F.least(n, m), F.greatest(n, m)
    at = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    pair = lambda i: F.concat(F.substr(a, i, F.lit(1)), F.substr(b, i, F.lit(1)))
    same = F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    alike = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.coalesce(F.element_at(_map(LOOK_ALIKE), pair(i)), F.lit(0)) / 100.0)
    score = same / long * 100 + alike / long * 30 - (long - short) * 10
    return F.when(a == b, 100.0).when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def likeness(a: Column, b: Column) -> Column:
    """0-1 of two single symbols."""
    known = F.coalesce(F.element_at(_map(ALIKE), F.concat(a, b)), F.element_at(_map(ALIKE), F.concat(b, a)))
    return F.when(a == b, 1.0).otherwise(F.coalesce(known, F.when(F.lower(a) == F.lower(b), 0.9), F.lit(0.1)))


def bound(parts: dict[str, Column], use) -> Column:
    """use(parts) with each part computed once."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in parts.items()))), use), F.lit(0))


def characters(a: Column, b: Column) -> Column:
    """0-1: mean likeness of characters side by side; if one text is a character longer, the best way to leave one of its out counts too."""
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    most = F.greatest(n, m)
    total = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: F.when(p.isNull() | q.isNull(), 0.0).otherwise(likeness(p, q))), F.lit(0.0), lambda s, v: s + v)
    longer, shorter = F.when(n > m, x).otherwise(y), F.when(n > m, y).otherwise(x)
    without = lambda i: F.concat(F.slice(longer, F.lit(1), i - 1), F.slice(longer, i + 1, most))
    skips = F.array_max(F.transform(F.sequence(F.lit(1), most), lambda i: total(without(i), shorter)))
    return F.when(F.abs(n - m) == 1, F.greatest(total(x, y), skips)).otherwise(total(x, y)) / most


def structured(a: Column, b: Column) -> Column:
    """0-1 by what a reading a shares with a move b: square, else piece and file, else piece and rank, else characters and square; squares of origin and lengths that differ take some off, captures, checks and mates shift it. Castling is like itself only."""
    bare = lambda m: F.regexp_replace(m, "[+#]+$", "")
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    piece = lambda m: F.when(F.substring(m, 1, 1).isin(*"KQRBN"), F.substring(m, 1, 1)).otherwise("P")
    clean = lambda m: F.translate(m, "x", "")
    square = lambda m: F.nullif(F.regexp_extract(clean(m), "([a-h][1-8])$", 1), F.lit(""))
    origin = lambda m: F.when((F.length(clean(m)) >= 4) & F.substring(clean(m), 2, 1).rlike("[a-h1-8]"), F.substring(clean(m), 2, 1))
    parts = {"o": bare(a), "c": bare(b), "upper": F.translate(F.upper(bare(a)), "0", "O")}
    for name, m in (("a", bare(a)), ("b", bare(b))):
        parts |= {f"piece_{name}": piece(m), f"square_{name}": square(m), f"origin_{name}": origin(m)}
    return bound(parts, lambda z: _structured(a, b, z))


def _structured(a: Column, b: Column, z: Column) -> Column:
    has = lambda m, x: m.contains(x)
    o, c, upper, p, q, s, t, u, v = (z[k] for k in ("o", "c", "upper", "piece_a", "piece_b", "square_a", "square_b", "origin_a", "origin_b"))
    file, rank = (lambda z: F.substring(z, 1, 1)), (lambda z: F.substring(z, 2, 1))
    off = F.abs(F.length(o) - F.length(c))
    loss = F.when(off >= 2, 0.15 * off).otherwise(0.0)
    same, named = p == q, (p != "P") & (q != "P")
    least = lambda x: F.greatest(F.lit(0.1), x)
    origins = F.when(u.isNotNull() & v.isNotNull() & (u != v), 0.5 + 0.5 * likeness(u, v)).otherwise(1.0)
    on_square = F.when(same, 0.98 - F.when((p != "P") & (u.isNull() != v.isNull()), 0.12).otherwise(0.0)).otherwise(F.when(named, 0.80).otherwise(0.70) + 0.15 * likeness(p, q))
    on_file = (0.85 + 0.15 * likeness(rank(s), rank(t))) * origins
    on_rank = 0.75 + 0.20 * likeness(file(s), file(t))
    on_rank = F.when((p != "P") & u.isNotNull() & v.isNotNull(), F.when(u == v, on_rank + 0.05).otherwise(on_rank * origins)).otherwise(on_rank)
    plain = characters(o, c)
    weighed = F.when(s.isNotNull() & t.isNotNull(), plain * 0.4 + (likeness(file(s), file(t)) + likeness(rank(s), rank(t))) / 2 * 0.6).otherwise(plain)
    weighed = F.when(same & (p != "P"), F.greatest(weighed, F.lit(0.35))).when(~same & named, weighed * 0.7).otherwise(weighed)
    base = F.when(o == c, 1.0).when(s == t, least(on_square - loss)).when(same & (file(s) == file(t)), least(on_file - loss)).when(same & (rank(s) == rank(t)), least(on_rank - loss)).otherwise(weighed - loss)
    mark = lambda x, both, lost: F.when(has(a, x), F.when(has(b, x), both).otherwise(lost)).otherwise(0.0)
    moved = base + mark("x", 0.08, -0.06) + F.when(~has(a, "x") & has(b, "x"), -0.03).otherwise(0.0) + mark("+", 0.25, -0.15) + mark("#", 0.30, -0.20)
    castles = c.isin("O-O", "O-O-O")
    found = F.least(F.when(o == c, 1.0).otherwise(0.98), F.greatest(F.lit(0.0), moved))
    is_castle = (upper.isin("O-O", "OO") & (c == "O-O")) | (upper.isin("O-O-O", "OOO") & (c == "O-O-O"))
    return F.when(o == c, found).when(is_castle, 1.0).when(has(upper, "O") | castles | (o == "") | (c == ""), 0.1).otherwise(found)


def on_distinct_pairs(df: DataFrame, a: str, b: str, measure, name: str) -> DataFrame:
    """df with measure(a, b), computed once for each different pair and joined back."""
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct().withColumn(name, measure(F.col("_a"), F.col("_b")))
    return df.join(pairs, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_a", "_b")


def best_of(moves: DataFrame, readings: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, similarity, text): the reading most like each candidate among those of enough confidence; of equals, and where none has anything in common, the first; the top reading where none is sure enough. moves(keys, candidate), readings(keys, rk, text, conf)."""
    pairs = on_distinct_pairs(moves.join(readings, keys), "text", "candidate", structured, "similarity")
    seen = F.col("conf") >= least
    best = F.struct(-F.round("similarity", 9), "rk")
    value = F.struct("similarity", "text")
    found = F.coalesce(F.min_by(value, F.when(seen, best)), F.min_by(value, "rk"))
    return pairs.groupBy(*keys).agg(found.alias("x")).select(*keys, "x.similarity", "x.text")


def rank_vocabulary(readings: DataFrame, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """(reading, move, similarity, place): the closest allowed moves of each different reading in percent, among those with its square, file and piece, or rank and piece; readings that don't parse, and castling, are compared with all moves of their length or one more or less."""
    from pyspark.sql import Window

    def blocks(df: DataFrame, name: str) -> DataFrame:
        p = parse_move(F.col(name))
        keys = F.array_compact(F.array(p["target"], F.concat(F.lit("f"), p["piece"], p["file"]), F.concat(F.lit("r"), p["piece"], p["rank"])))
        size = F.length(name)
        sizes = F.transform(F.array(size - 1, size, size + 1) if name == "reading" else F.array(size), lambda n: F.concat(F.lit("n"), n.cast("string")))
        lost = (F.size(keys) == 0) | p["castle"].isNotNull()
        return df.select(name, F.explode(F.concat(keys, F.when(lost, sizes).otherwise(F.array().cast("array<string>"))) if name == "reading" else F.concat(keys, sizes)).alias("block"))

    near = blocks(readings.select("reading").distinct(), "reading").join(blocks(vocabulary.select("move").distinct(), "move"), "block").select("reading", "move").distinct()
    scored = near.withColumn("similarity", F.round(structured(F.col("reading"), F.col("move")) * 100, 4))
    w = Window.partitionBy("reading").orderBy(F.desc("similarity"), "move")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
