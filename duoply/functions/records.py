"""Column functions over names, dates, results, paths and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words before a number in names of scans.
TOKEN = r"(round|rnd|rd|r|board|bd|b|page|p)[-_ ]*([0-9]+)"


def normalize_date(d: Column) -> Column:
    s = F.trim(F.coalesce(d, F.lit("")))
    return F.when(s.rlike(r"^\d{4}-[A-Za-z]{3}-\d{2}$"), s).otherwise(F.regexp_replace(s, "[-/]", "."))


def normalize_result(r: Column) -> Column:
    """1-0, 0-1, 1/2-1/2 or *; unknown text is kept."""
    s = F.replace(F.regexp_replace(F.coalesce(r, F.lit("")), r"\s+", ""), F.lit("½"), F.lit("1/2"))
    return F.when(s.isin("1-0", "0-1", "1/2-1/2", "*"), s).when(s.isin("1/2", "=", "1/2-"), "1/2-1/2").when(s == "", "*").otherwise(s)


def oriented_result(cell: Column, color: Column) -> Column:
    """Result of a game from one player's cell (1, 0, ½, +, -, =) and colour."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    white = F.lower(color) == "w"
    return F.when(s.isin("½", "="), "1/2-1/2").when(s.isin("1", "+"), F.when(white, "1-0").otherwise("0-1")).when(s.isin("0", "-"), F.when(white, "0-1").otherwise("1-0")).otherwise("*")


def pair_result(cell: Column) -> Column:
    """Result of a game from a cell with both sides' symbols, apart (1-0, 0.5-0.5, ½:½) or together (10, +-, ==): a draw of either side is one, sides that don't agree and byes give *."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    low = F.lower(s)
    half = lambda x: F.replace(F.replace(F.replace(x, F.lit("½"), F.lit("5")), F.lit("1/2"), F.lit("5")), F.lit("0.5"), F.lit("5"))
    apart, close = r"^([015])\s*[-:]\s*([015])$", "^([10=+5-])([10=+5-])$"
    loose, tight = half(low), F.replace(F.regexp_replace(s, r"\s+", ""), F.lit("½"), F.lit("5"))
    side = lambda i: F.when(loose.rlike(apart), F.regexp_extract(loose, apart, i)).otherwise(F.regexp_extract(tight, close, i))
    won, lost, even = (lambda x: x.isin("1", "+")), (lambda x: x.isin("0", "-")), (lambda x: x.isin("=", "5"))
    w, b = side(1), side(2)
    found = F.when(even(w) | even(b), "1/2-1/2").when(won(w) & lost(b), "1-0").when(lost(w) & won(b), "0-1").otherwise("*")
    return F.when((s == "") | low.rlike("^[uhz]"), "*").when(low.contains("draw"), "1/2-1/2").otherwise(found)


def find_date(text: Column) -> Column:
    """The first date in a text: 2024-May-01 as it is, else one with dots or slashes, with dots; empty without any."""
    named, plain = r"(\d{4})-(\w{3})-(\d{2})", r"(\d{4})[./](\d{2})[./](\d{2})"
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(named), F.regexp_extract(t, named, 0)).otherwise(F.replace(F.regexp_extract(t, plain, 0), F.lit("/"), F.lit(".")))


def person_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")


def pair_key(a: Column, b: Column) -> Column:
    x, y = person_key(a), person_key(b)
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))


def identity(section: Column, number: Column, name: Column) -> Column:
    return F.when(F.coalesce(number, F.lit(0)) != 0, F.concat_ws(":", F.lit("sno"), section, number.cast("string"))).otherwise(F.concat(F.lit("name:"), person_key(name)))


def _first(text: Column, kind: str) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    hit = F.get(F.filter(tokens, lambda t: F.substring(t, 1, 1) == kind), F.lit(0))
    return F.regexp_extract(hit, "([0-9]+)$", 1).cast("long")


def scan_name(name: Column) -> Column:
    """struct(section, round, board, page) of a file name, or null if it has neither round nor board."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    section = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(stem, f"(?i)^(.*?){TOKEN}", 1), "[-_ ]+$", "")), F.lit(""))
    parts = {k: _first(stem, k[0]) for k in ("round", "board", "page")}
    found = F.struct(section.alias("section"), *(v.alias(k) for k, v in parts.items()))
    return F.when(parts["round"].isNotNull() | parts["board"].isNotNull(), found)


def scan_path(path: Column) -> Column:
    """struct(section, round, board, page) of the folders of a path; the page comes from its file name."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    is_round, is_board = (lambda x: x.rlike(r"(?i)^(round|rd|r)[-_ ]*\d+$")), (lambda x: x.rlike(r"(?i)^(board|bd|b)[-_ ]*\d+$"))
    number = lambda rule: F.regexp_extract(F.get(F.filter(folders, rule), F.lit(0)), r"(\d+)$", 1).cast("long")
    at = F.array_position(F.transform(folders, is_round), True).cast("int")
    other = F.filter(folders, lambda x: ~is_round(x) & ~is_board(x))
    section = F.when(at > 1, F.get(folders, at - 2)).otherwise(F.get(other, F.lit(0)))
    page = _first(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), "p")
    return F.struct(section.alias("section"), number(is_round).alias("round"), number(is_board).alias("board"), page.alias("page"))


def layout_matches(cached: Column, current: Column) -> Column:
    """Equal signatures; a side without @N is compared without it, and a missing side matches."""
    bare = lambda x: F.regexp_replace(x, "@[0-9]+", "")
    return F.coalesce(F.when(cached.contains("@"), cached == current).otherwise(cached == bare(current)), F.lit(True))
