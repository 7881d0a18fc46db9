"""Sequence alignment and edit replay: one game is one group, small frames in, rows out."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply import config as C
from duoply.operators.reconcile import normed
from duoply.sources.shared import kept


def pool_scores(c: DataFrame, reach: int | None = None) -> DataFrame:
    """(game_id, i, j, overlap): overlap of ply i of sheet 1 with ply j of sheet 2, at most `reach` apart; pairs that share nothing are absent."""
    n = normed(c)
    a = n.where("sheet = 1").groupBy("game_id", F.col("ply").alias("i"), "norm").agg(F.max_by("conf", "rk").alias("a"))
    b = n.where("sheet = 2").select("game_id", F.col("ply").alias("j"), "norm", F.col("conf").alias("b"))
    near = a.join(b, ["game_id", "norm"])
    if reach is not None:
        near = near.where(F.abs(F.col("i") - F.col("j")) <= reach)
    return near.groupBy("game_id", "i", "j").agg(F.sum(F.col("a") + F.col("b")).alias("overlap"))


def global_alignment(score: np.ndarray, gap: float = C.GAP_COST) -> list[tuple[str, int, int]]:
    """(kind, i, j) from the start; of equal ways the diagonal comes first, then a gap in the second sequence, then in the first."""
    n, m = score.shape
    above, way = [gap * j for j in range(m + 1)], [[2] * (m + 1)]
    for i, scores in enumerate((score + C.MATCH_BIAS).tolist(), 1):
        row, ways = [gap * i], [1]
        for j, s in enumerate(scores):
            best, k = above[j] + s, 0
            if above[j + 1] + gap > best + 1e-9:
                best, k = above[j + 1] + gap, 1
            if row[j] + gap > best + 1e-9:
                best, k = row[j] + gap, 2
            row.append(best)
            ways.append(k)
        above = row
        way.append(ways)
    path, i, j = [], n, m
    while i or j:
        k = way[i][j]
        path.append((("match", "gap_s2", "gap_s1")[k], i - 1 if k != 2 else -1, j - 1 if k != 1 else -1))
        i, j = i - (k != 2), j - (k != 1)
    return path[::-1]


#: The Arrow types of the columns of results. Groups go to Python and back as Arrow tables: of a game's time, pandas frames took most.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def frame(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of a result, which keep the types of the schema if there are none."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


ALIGNED = "game_id long, step int, kind string, i int, j int, score double"


def align(c: DataFrame) -> DataFrame:
    """(game_id, step, kind, i, j, score) of each game's two readings. Scores are joined by Spark; a group holds one game's score table."""
    sizes = c.groupBy(F.col("game_id").alias("_game")).agg(F.coalesce(F.max(F.when(F.col("sheet") == 1, F.col("ply"))) + 1, F.lit(0)).alias("n"), F.coalesce(F.max(F.when(F.col("sheet") == 2, F.col("ply"))) + 1, F.lit(0)).alias("m"))

    def one(key, scores, size):
        if not len(size):
            return frame([], ALIGNED)
        table = np.zeros((size["n"][0].as_py(), size["m"][0].as_py()))
        table[scores["i"].to_numpy(), scores["j"].to_numpy()] = scores["overlap"].to_numpy()
        rows = [(key[0].as_py(), k, kind, i, j, float(table[i, j]) if kind == "match" else 0.0) for k, (kind, i, j) in enumerate(global_alignment(table))]
        return frame(rows, ALIGNED)

    return pool_scores(c).groupBy("game_id").cogroup(sizes.groupBy("_game")).applyInArrow(one, ALIGNED)


def in_order(rows: pa.Table, order: list[str], columns: list[str]):
    """The rows of a group in order, as tuples of columns."""
    t = rows.sort_by([(c, "ascending") for c in order])
    return zip(*(t[c].to_pylist() for c in columns))


class Sheets:
    """The two readings of one game: for each sheet a list of cells, each a pool of (move, conf) by rank; a missing ply is an empty pool."""

    def __init__(self, rows: pa.Table):
        self.cells: list[list[list[tuple[str, float]]]] = [[], []]
        for sheet, ply, norm, conf in in_order(rows, ["sheet", "ply", "rk"], ["sheet", "ply", "norm", "conf"]):
            own = self.cells[sheet - 1]
            own += [[] for _ in range(ply + 1 - len(own))]
            own[ply].append((norm, conf))

    def top(self, sheet: int, ply: int) -> str:
        pool = self.cells[sheet][ply]
        return pool[0][0] if pool else ""

    def apply(self, issue: dict) -> None:
        own = self.cells[issue["sheet"] - 1]
        if issue["action"] == "insert":
            own[issue["at"] : issue["at"]] = [[] for _ in range(issue["n"])]
        else:
            for ply in sorted(issue["plies"], reverse=True):
                del own[ply]


def shared(x: list, y: list) -> float:
    """Overlap of two pools: the confidences of both sides, of every move in both."""
    first = dict(x)
    return sum(first[m] + c for m, c in y if m in first)


def likeness(x: list, y: list) -> tuple[float, float]:
    """(piece, file) agreement of two pools, at most STRUCTURED_CAP each."""
    parts = (lambda m: m[:1] if m[:1] in "KQRBN" and m[:1] else "P"), (lambda m: f[-1][0] if (f := re.findall("[a-h][1-8]", m)) else "")
    out = []
    for part in parts:
        mass = [{}, {}]
        for side, pool in zip(mass, (x, y)):
            for m, c in pool:
                if k := part(m):
                    side[k] = side.get(k, 0.0) + c
        out.append(min(C.STRUCTURED_CAP, sum(mass[0][k] + mass[1][k] for k in mass[0] if k in mass[1])))
    return out[0], out[1]


def members(path: list, score: list[float], k: int) -> list[int]:
    """Steps of the gap that begins at step k; what one sheet has too much may go on behind one weak match."""
    out, kind = [k], path[k][0]
    while out[-1] + 1 < len(path):
        end = out[-1]
        if path[end + 1][0] == kind:
            out.append(end + 1)
        elif kind == "gap_s2" and path[end + 1][0] == "match" and score[end + 1] < C.ANCHOR and end + 2 < len(path) and path[end + 2][0] == kind:
            out.append(end + 2)
        else:
            break
    return out


def anchor(path: list, score: list[float], steps, single: bool) -> float | None:
    """Strength of the nearest firm match, or for one ply of the best of the nearest few."""
    found, seen = [], 0
    for k in steps:
        if path[k][0] == "match":
            seen += 1
            if score[k] >= C.ANCHOR:
                found.append(score[k])
                if not single:
                    break
            if single and seen == C.SINGLE_SCAN:
                break
    return max(found, default=None)


def first_gap(s: Sheets, start: int = 0, ends: tuple[int, int] | None = None) -> dict | None:
    """The first gap with firm matches on both sides when the plies from start on (up to ends) are aligned: an insert where sheet 1 lacks plies, a delete where it has too many; `other` is the same edit on sheet 2."""
    one, two = (own[start:end] for own, end in zip(s.cells, ends or (None, None)))
    table = np.array([[shared(x, y) for y in two] for x in one], dtype=float).reshape(len(one), len(two))
    path = global_alignment(table)
    score = [float(table[i, j]) if kind == "match" else 0.0 for kind, i, j in path]
    for k, (kind, _, _) in enumerate(path):
        if kind == "match":
            continue
        steps = members(path, score, k)
        if kind == "gap_s2":  # a bridged cell that reads like the next one goes in its place
            for n, (a, b) in enumerate(zip(steps, steps[1:])):
                if b - a == 2 and (t := s.top(0, start + path[a + 1][1])) and t == s.top(0, start + path[b][1]):
                    steps[n + 1] = a + 1
        single, end = len(steps) == 1, max(steps[-1], members(path, score, k)[-1])
        before, after = anchor(path, score, range(k - 1, -1, -1), single), anchor(path, score, range(end + 1, len(path)), single)
        if before is None or after is None or min(before, after) < (C.SINGLE_ANCHOR if single else C.ANCHOR):
            continue
        if single and substituted(path, score, end):
            continue
        plies = sorted(start + path[x][2 if kind == "gap_s1" else 1] for x in steps)
        gone = {"action": "delete", "sheet": 2 if kind == "gap_s1" else 1, "at": plies[0], "n": len(plies), "plies": plies, "before": before, "after": after}
        new = {"action": "insert", "sheet": 3 - gone["sheet"], "at": plies[0], "n": len(plies), "plies": [], "before": before, "after": after}
        return new | {"other": gone} if kind == "gap_s1" else gone | {"other": new}
    return None


def substituted(path: list, score: list[float], end: int) -> bool:
    """Whether exactly one ply of the other kind follows a gap of one ply before the next firm match: that is a misread cell."""
    kind, n = path[end][0], 0
    for k in range(end + 1, len(path)):
        if path[k][0] not in ("match", kind):
            n += 1
        elif path[k][0] == kind or n or score[k] >= C.ANCHOR:
            break
    return n == 1


def repeated_near(s: Sheets, sheet: int, near: int) -> dict | None:
    """The first full move near a ply that repeats the one before it on a sheet; a recapture on one square is none."""
    cells, square = s.cells[sheet], lambda m: (re.findall(r"([a-h][1-8])(?:=?[QRBN])?$", m) or [""])[0]
    begin = max(0, near - C.REPEAT_REACH) // 2 * 2
    for i in range(begin, min(len(cells) - 3, near + C.REPEAT_REACH), 2):
        white, black = s.top(sheet, i), s.top(sheet, i + 1)
        if not all(cells[i : i + 4]) or not white or white != s.top(sheet, i + 2):
            continue
        if "x" in white and "x" in black and square(white) and square(white) == square(black):
            continue
        w, b = shared(cells[i], cells[i + 2]), shared(cells[i + 1], cells[i + 3])
        if w > C.REPEAT_WHITE and (b > C.REPEAT_BLACK or sum(likeness(cells[i + 1], cells[i + 3])) >= C.REPEAT_STRUCTURED):
            return {"action": "delete_duplicate", "sheet": sheet + 1, "at": i + 2, "n": 2, "plies": [i + 2, i + 3], "before": None, "after": None}
    return None


def parting(s: Sheets, start: int) -> tuple[int | None, int | None]:
    """(ply, end): where the readings part from ply `start` on, by a window with little overlap or by a short island without any, whichever comes first; end is that of an island."""
    both = min(map(len, s.cells))
    overlap = [shared(x, y) for x, y in zip(*s.cells)]
    blank = [not (x and y) for x, y in zip(*s.cells)]
    drop = None
    for a in range(start, both - C.DROP_WINDOW + 1, 2):
        known = [o for o, b in zip(overlap[a : a + C.DROP_WINDOW], blank[a : a + C.DROP_WINDOW]) if not b]
        if not known or sum(known) / len(known) < C.DROP_BELOW:
            drop = a
            break
    firm = lambda a, b: a >= 0 and b <= both and min(overlap[a:b]) >= C.DROPOUT_ANCHOR
    least, most = C.DROPOUT_LENGTH
    a = max(start, C.DROPOUT_ANCHORS)
    while a < both and (drop is None or a < drop):
        b = a
        while b < both and overlap[b] < C.DROPOUT_BELOW:
            b += 1
        if least <= b - a <= most and firm(a - C.DROPOUT_ANCHORS, a) and firm(b, b + C.DROPOUT_ANCHORS):
            return a, b
        a = b + 1
    return drop, None


def next_issue(s: Sheets, start: int) -> tuple[dict | None, int | None]:
    """(issue, end of an island that gave none) from a search point on. Sheets of very different lengths give none: one player stopped writing."""
    n, m = map(len, s.cells)
    if abs(n - m) > C.SILENT_TAIL:
        return None, None
    drop, island = parting(s, start)
    if drop is None:
        return (first_gap(s, max(0, start - C.ALIGN_BACK)) if n != m else None), None
    found = repeated_near(s, 0, drop) or repeated_near(s, 1, drop) or first_gap(s, max(0, drop - C.ALIGN_BACK), (min(drop + C.ALIGN_AHEAD, n), min(drop + C.ALIGN_AHEAD, m)))
    return found, island if found is None else None


def issues(s: Sheets) -> list[dict]:
    """All issues, each once, by moving the search point behind what was found."""
    out, start = [], 0
    for _ in range(C.MOST_ISSUES):
        found, island = next_issue(s, start)
        if found is None and island is None:
            break
        if found is None:
            start = max(start + 2, island + 2)
            continue
        if not any(all(found[k] == x[k] for k in ("action", "sheet", "at", "plies", "n")) for x in out):
            out.append(found)
        start = max(start + 2, found["at"] - 1 + found["n"] + 4 if found["action"] == "insert" else found["plies"][-1] + 4)
    return out


ISSUE = "game_id long, place int, direction string, action string, sheet int, at int, n int, plies string, before double, after double"


def issue_rows(game: int, found: list[dict]) -> list[tuple]:
    row = lambda k, d, x: (game, k, d, x["action"], x["sheet"], x["at"], x["n"], ",".join(map(str, x["plies"])), x["before"], x["after"])
    return [r for k, x in enumerate(found) for r in ((row(k, "primary", x), row(k, "inverse", x["other"])) if "other" in x else (row(k, "primary", x),))]


def by_game(c: DataFrame, fn, schema: str) -> DataFrame:
    """fn(game_id, Sheets) -> rows, for each game of the candidates c."""
    rows = normed(c).select("game_id", "sheet", "ply", "rk", "norm", "conf")
    return rows.groupBy("game_id").applyInArrow(lambda key, t: frame(fn(key[0].as_py(), Sheets(t)), schema), schema)


def gap_suggestions(c: DataFrame) -> DataFrame:
    """The first suggestion of each game whose whole readings are aligned, in both directions."""
    return by_game(c, lambda game, s: issue_rows(game, [x] if (x := first_gap(s)) else []), ISSUE)


def cascade(c: DataFrame) -> DataFrame:
    """All issues of each game, by place: repeated rows, missing and superfluous plies, in both directions."""
    return by_game(c, lambda game, s: issue_rows(game, issues(s)), ISSUE)


APPLIED = "game_id long, place int, action string, sheet int, at int, n int, plies string, before double, after double"


def auto_apply(c: DataFrame, threshold: float = float("inf")) -> DataFrame:
    """The edits of each game in the order they were applied: the next issue, as long as both its anchors reach the threshold (repeated rows have none and end it), each on what the one before left; none by default."""

    def run(game: int, s: Sheets) -> list[tuple]:
        out = []
        while len(out) < C.MOST_APPLIES and np.isfinite(threshold):
            found, _ = next_issue(s, 0)
            if found is None or found["before"] is None or min(found["before"], found["after"]) < threshold:
                break
            s.apply(found)
            out.append((game, len(out), found["action"], found["sheet"], found["at"], found["n"], ",".join(map(str, found["plies"])), found["before"], found["after"]))
        return out

    return by_game(c, run, APPLIED)


EDITED = "game_id long, sheet int, ply long, move string, conf double, source_ply long"


def edited_cells(c: DataFrame, applied: DataFrame, before: int | None = None) -> DataFrame:
    """(game_id, sheet, ply, move, conf, source_ply) after the edits, or after those whose place is less than `before`; inserted plies read ???."""
    log = applied if before is None else applied.where(F.col("place") < before)
    log = log.select(F.col("game_id").alias("_game"), "place", "action", "sheet", "at", "n", "plies")
    tops = c.where("rk = 0").select("game_id", "sheet", "ply", "move", "conf")

    def run(key, cells, edits):
        sheets = {1: [], 2: []}
        for sheet, ply, move, conf in in_order(cells, ["sheet", "ply"], ["sheet", "ply", "move", "conf"]):
            own = sheets[sheet]
            own += [None] * (ply - len(own))
            own.append((move, conf, ply))
        for sheet, action, at, n, plies in in_order(edits, ["place"], ["sheet", "action", "at", "n", "plies"]):
            if action == "insert":
                sheets[sheet][at:at] = [("???", 0.0, -1)] * n
            else:
                for ply in sorted(map(int, plies.split(",")), reverse=True):
                    del sheets[sheet][ply]
        return frame([(key[0].as_py(), sheet, ply, *x) for sheet, own in sheets.items() for ply, x in enumerate(own) if x], EDITED)

    return tops.groupBy("game_id").cogroup(log.groupBy("_game")).applyInArrow(run, EDITED)


#: What a missing key counts as: it comes first in Spark's order.
FIRST = int(np.iinfo(np.int64).min)


def whole_groups(batches):
    """Tables that hold whole groups each, from batches in order of their first column; a table is a batch or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).fill_null(FIRST).to_numpy()
        if held and held[-1].column(0)[-1:].fill_null(FIRST)[0].as_py() != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut := int(np.searchsorted(ids, ids[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def offset_scores(t: pa.Table, window: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(games, last plies, first rows, scores): from a game's first row on, row i has what plies i to i + window - 1 share at offsets -far to far. t(game_id, sheet, ply, rk, norm, conf) holds whole games in order."""
    game, sheet, ply, rk, conf = (t[x].to_numpy() for x in ("game_id", "sheet", "ply", "rk", "conf"))
    norm = t["norm"].combine_chunks().dictionary_encode().indices.to_numpy()
    games, first, g = np.unique(game, return_index=True, return_inverse=True)
    last = np.maximum(np.maximum.reduceat(ply, first), 0)
    rows = np.maximum(last, window - 1) + 1
    begin = np.cumsum(rows) - rows
    reach = int(last.max()) + 2 * far + 1
    key = (g * (int(norm.max()) + 1) + norm) * reach + ply + far  # game, move, ply
    a, b = np.flatnonzero((sheet == 1) & (ply >= 0)), np.flatnonzero((sheet == 2) & (ply >= -far))
    a, b = a[np.lexsort((rk[a], key[a]))], b[np.argsort(key[b], kind="stable")]
    a = a[np.append(key[a][1:] != key[a][:-1], True)[: len(a)]]  # the last rank of equal moves
    low, high = np.searchsorted(key[b], key[a] - far), np.searchsorted(key[b], key[a] + far, "right")
    n = high - low
    x, y = np.repeat(a, n), b[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
    cell = (begin[g[x]] + ply[x]) * (2 * far + 1) + ply[y] - ply[x] + far
    overlap = np.bincount(cell, np.nan_to_num(conf[x] + conf[y]), int(rows.sum()) * (2 * far + 1)).reshape(-1, 2 * far + 1)
    return games, last, begin, np.round(sum(overlap[k : len(overlap) - window + 1 + k] for k in range(window)), 9)


WINDOWS = pa.schema([("game_id", pa.int64()), ("start", pa.int64()), ("base", pa.int32()), ("best", pa.int32()), ("at_base", pa.float64()), ("at_best", pa.float64()), ("transition", pa.bool_())])


def offset_windows(c: DataFrame, window: int = 8, step: int = 2, near: int = 4, far: int = 12, gain: float = 0.2) -> DataFrame:
    """(game_id, start, base, best, at_base, at_best, transition) of each window of a game: the offset that holds so far, the best one near it and not beyond `far` (the smallest of equals), and what the sheets share at both; a transition makes the best one the base of the windows behind, where it wins by more than `gain`.

    Rows are shuffled and sorted once, by game; a task scores the games of a
    batch together and folds each one's windows in order. The last window may
    begin between two steps.
    """

    def run(batches):
        for t in whole_groups(batches):
            out = []
            *games, scores = offset_scores(t, window, far)
            for game, last, begin in zip(*(x.tolist() for x in games)):
                end, base = max(0, last - window + 1), 0
                starts = [*range(0, end + 1, step), *([end] if end % step else [])]
                for start, row in zip(starts, scores[begin + np.array(starts)].tolist()):
                    low = max(-far, base - near)
                    tried = row[low + far : min(far, base + near) + far + 1]
                    top, own = max(tried), row[base + far]
                    best = low + tried.index(top)
                    moved = best != base and top > own + gain
                    out.append((game, start, base, best, own, top, moved))
                    base = best if moved else base
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), WINDOWS)], schema=WINDOWS)

    rows = normed(c).select(*(F.col(x).cast(k).alias(x) for x, k in (("game_id", "long"), ("sheet", "int"), ("ply", "long"), ("rk", "int"), ("norm", "string"), ("conf", "double"))))
    games = rows.where("game_id is not null and ply is not null").repartition("game_id").sortWithinPartitions("game_id")
    return games.mapInArrow(run, "game_id long, start long, base int, best int, at_base double, at_best double, transition boolean")


def running_offset(c: DataFrame, window: int = 8, step: int = 2, near: int = 4, far: int = 12, gain: float = 0.2) -> DataFrame:
    """(game_id, start, before, offset, delta, at_base, at_best): the transitions of offset_windows()."""
    moved = offset_windows(c, window, step, near, far, gain).where("transition")
    return moved.select("game_id", "start", F.col("base").cast("long").alias("before"), F.col("best").cast("long").alias("offset"), (F.col("best") - F.col("base")).cast("long").alias("delta"), "at_base", "at_best")


def near_repeats(batches):
    """The rows of plies p to p + 3 of all even plies p whose top is that of p + 2, from batches (game_id, sheet, ply, rk, norm, conf) in order of games."""
    for t in whole_groups(batches):
        game, sheet, ply, rk = (t[x].to_numpy() for x in ("game_id", "sheet", "ply", "rk"))
        moves = t["norm"].combine_chunks().dictionary_encode()
        norm, n = moves.indices.to_numpy(), len(moves.dictionary)
        own = np.unique(np.unique(game, return_inverse=True)[1] * (int(sheet.max()) - int(sheet.min()) + 1) + sheet - sheet.min(), return_inverse=True)[1]
        cell = own * (int(ply.max()) - int(ply.min()) + 4) + ply - ply.min()  # none beside a sheet's last three
        top = (rk == 0) & (t["norm"].to_numpy() != "")
        even = top & (ply % 2 == 0)
        begins = np.unique(cell[even][np.isin((cell[even] + 2) * n + norm[even], cell[top] * n + norm[top])])
        yield from t.filter(pa.array(np.isin(cell, begins[:, None] + np.arange(4)))).to_batches()


def repeated_rows(c: DataFrame) -> DataFrame:
    """(game_id, sheet, at, kind, white, black): full moves at ply `at` that the next one of the same sheet repeats: white halves with the same top, black ones with the same top or of one piece and file; pools overlap."""
    n = normed(c).select("game_id", "sheet", "ply", "rk", "norm", "conf")
    # few cells take part: those from a white half to the black one behind the next with its top; the rest goes before any join
    n = kept(n.where("game_id is not null and sheet is not null and ply is not null").repartition("game_id").sortWithinPartitions("game_id").mapInArrow(near_repeats, n.schema))
    tops = n.where("rk = 0").select("game_id", "sheet", "ply", F.col("norm").alias("top")).where("top <> ''")
    keys = ["game_id", "sheet", "ply"]
    later = lambda df: df.withColumn("ply", F.col("ply") - 2)
    early = n.groupBy(*keys, "norm").agg(F.max_by("conf", "rk").alias("a"))
    overlap = early.join(later(n).select(*keys, "norm", F.col("conf").alias("b")), [*keys, "norm"]).groupBy(*keys).agg(F.sum(F.col("a") + F.col("b")).alias("overlap"))
    piece = F.when(F.substring("norm", 1, 1).isin(*"KQRBN"), F.substring("norm", 1, 1)).otherwise("P")
    parts = n.select(*keys, "conf", F.explode(F.array(F.struct(F.lit("piece").alias("k"), piece.alias("v")), F.struct(F.lit("file").alias("k"), F.substring(F.regexp_extract("norm", "([a-h][1-8])[^a-h]*$", 1), 1, 1).alias("v")))).alias("x")).where("x.v <> ''")
    mass = parts.groupBy(*keys, "x.k", "x.v").agg(F.sum("conf").alias("m"))
    both = mass.join(later(mass).withColumnRenamed("m", "m2"), [*keys, "k", "v"]).groupBy(*keys).agg(*(F.least(F.lit(C.STRUCTURED_CAP), F.sum(F.when(F.col("k") == k, F.col("m") + F.col("m2")))).alias(k) for k in ("piece", "file")))
    pairs = tops.join(later(tops).withColumnRenamed("top", "next"), keys).join(overlap, keys, "left").join(both, keys, "left").withColumns({"same": F.col("top") == F.col("next"), "overlap": F.coalesce("overlap", F.lit(0.0))})
    white = pairs.where((F.col("ply") % 2 == 0) & F.col("same") & (F.round("overlap", 9) >= C.ROWS_WHITE)).select("game_id", "sheet", F.col("ply").alias("at"), F.col("overlap").alias("white"))
    alike = (F.round("piece", 9) >= C.ROWS_PIECE) & (F.round("file", 9) >= C.ROWS_FILE)
    kind = F.when(F.col("same") & (F.round("overlap", 9) >= C.ROWS_BLACK), "exact").when(~F.col("same") & alike, "structured")
    black = pairs.where(F.col("ply") % 2 == 1).select("game_id", "sheet", (F.col("ply") - 1).alias("at"), kind.alias("kind"), F.col("overlap").alias("black")).where("kind is not null")
    return white.join(black, ["game_id", "sheet", "at"]).select("game_id", "sheet", "at", "kind", "white", "black")


def shift_suggestions(c: DataFrame, offsets: DataFrame, repeats: DataFrame) -> DataFrame:
    """(game_id, cause, sheet, action, move, half, confidence, priority): what repeated rows and moved offsets ask for, most urgent first by priority.

    A repeated row is deleted. An offset that moves by a full move deletes it on
    the sheet ahead or, less surely, inserts one on the other, unless rows
    repeated on the sheet ahead explain it; by two moves it inserts both; by one
    or three plies it is only to be looked at. Weak overlaps are of low
    confidence. Games with a very short sheet give none.
    """
    lengths = c.where("rk = 0").groupBy("game_id").agg(F.least(F.count_if(F.col("sheet") == 1), F.count_if(F.col("sheet") == 2)).alias("n")).where(F.col("n") >= C.SHORTEST_SHEET).select("game_id")
    text = lambda x: F.lit(x)
    row = F.floor(F.col("at") / 2) + 1
    guns = repeats.select("game_id", text("repeat").alias("cause"), "sheet", text("delete").alias("action"), (row + 1).alias("move"), text("w").alias("half"), text("high").alias("confidence"), row.alias("priority"))
    ahead = F.when(F.col("delta") < 0, 1).otherwise(2)
    o = offsets.withColumns({"ahead": ahead, "behind": 3 - ahead, "move": F.floor(F.col("start") / 2) + 1, "half": F.when(F.col("start") % 2 == 0, "w").otherwise("b"), "size": F.abs("delta")})
    told = repeats.select("game_id", F.col("sheet").alias("ahead"), F.lit(True).alias("told")).distinct()
    free = o.join(told, ["game_id", "ahead"], "left").where("size <> 2 or told is null")  # one pass: offsets are dear
    sure = lambda base: F.when(F.col("at_best") < C.WEAK_SHIFT, "low").otherwise(base)
    make = lambda cause, sheet, action, half, confidence, more: F.struct(text(cause).alias("cause"), F.col(sheet).alias("sheet"), text(action).alias("action"), half.alias("half"), confidence.alias("confidence"), (F.col("move") + more).alias("priority"))
    w, own = F.lit("w"), F.col("half")
    found = F.when(F.col("size") == 2, F.array(make("shift_2", "ahead", "delete", w, sure("medium"), 1000), make("shift_2", "behind", "insert_pair", own, sure("low"), 1100))).when(F.col("size") == 4, F.array(make("shift_4", "behind", "insert_double", w, sure("medium"), 800)))
    found = found.when(F.col("size") == 1, F.array(make("shift_1", "ahead", "investigate", own, text("low"), 1500))).when(F.col("size") == 3, F.array(make("shift_3", "ahead", "investigate", own, text("low"), 1700)))
    shifts = free.select("game_id", "move", F.explode(found).alias("x")).select("game_id", "x.cause", "x.sheet", "x.action", "move", "x.half", "x.confidence", "x.priority")
    return guns.unionByName(shifts).join(lengths, "game_id", "left_semi")


REPLAYED = pa.schema([("game_id", pa.int64()), ("save", pa.int64()), ("i", pa.int64()), ("id", pa.int64()), ("reason", pa.string())])


def replay(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final ids (game_id, i, id, num, color), rejects (game_id, seq, reason)): insert and delete by position, in order of seq. The first entry that doesn't fit, or after which the length isn't the recorded one (a column length, if there is one), rejects its game as a whole. Entries may have a column saves (array<long>): then ids are those after each entry that has some, in a further column save for each of its numbers."""
    columns = ["game_id", "seq", "op", "pos", "event_id", *(c for c in ("length", "saves") if c in edits.columns)]
    whole = [F.col(c).cast("long").alias(c) if c in ("game_id", "seq", "pos", "event_id", "length") else F.col(c) for c in columns]

    def one(game, log, out):
        ids, n = [], len(out["i"])
        for seq, op, pos, new, length, numbers in log:
            if op == "insert" and pos is not None and pos <= len(ids):
                ids.insert(pos, new)
            elif op == "delete" and pos is not None and pos < len(ids):
                del ids[pos]
            else:
                return seq, f"{op} past the end"
            if length is not None and length != len(ids):
                return seq, f"length {len(ids)} is not {length}"
            for number in numbers or ():
                for column, values in (("game_id", [game] * len(ids)), ("save", [number] * len(ids)), ("i", range(len(ids))), ("id", ids)):
                    out[column].extend(values)
        out["reason"].extend([None] * (len(out["i"]) - n))
        return None

    def run(batches):
        for t in whole_groups(batches):
            game, n = t["game_id"].to_pylist(), t.num_rows
            ids = t["game_id"].fill_null(FIRST).to_numpy()
            ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), n]
            saves = t["saves"].to_pylist() if "saves" in columns else [None] * n
            if "saves" not in columns:
                for end in ends:
                    saves[end - 1] = [0]
            log = list(zip(*(t[x].to_pylist() for x in columns[1:5]), t["length"].to_pylist() if "length" in columns else [None] * n, saves))
            out = {x: [] for x in REPLAYED.names}
            for begin, end in zip([0, *ends], ends):
                sofar = len(out["i"])
                if wrong := one(game[begin], log[begin:end], out):
                    for x, value in zip(REPLAYED.names, (game[begin], None, wrong[0], None, wrong[1])):
                        out[x][sofar:] = [value]
            yield pa.RecordBatch.from_pydict(out, schema=REPLAYED)

    # rows travel in order, in batches of many games
    games = edits.select(*whole).repartition("game_id").sortWithinPartitions("game_id", F.asc_nulls_last("seq"))
    done = games.mapInArrow(run, "game_id long, save long, i long, id long, reason string")
    half = F.when(F.col("i") % 2 == 0, "w").otherwise("b")
    final = done.where("reason is null").select("game_id", *(["save"] if "saves" in columns else []), "i", "id", (F.floor(F.col("i") / 2) + 1).alias("num"), half.alias("color"))
    return final, done.where("reason is not null").select("game_id", F.col("i").alias("seq"), "reason")


def captured(before: DataFrame, after: DataFrame) -> DataFrame:
    """(game_id, type, first, length, deleted, inserted, updated, sequence, contents, numbers): the entry that leads from one snapshot (game_id, i, id, and a payload if there is one) to another; what replay_entries() applies.

    deleted (ids) and inserted (pos, id) are in order; if what stays has changed
    its order, sequence is the whole new order instead of these two, else it is
    null. updated are ids of cells that stay with another payload; contents
    holds the payloads of new and updated cells. numbers (i, num, color) are
    the cells of the new snapshot whose number or colour isn't that of their
    place, if it has these columns. first is the first position that changed.
    Unchanged games give no row.
    """
    load = lambda df: F.col("payload") if "payload" in df.columns else F.lit(None).cast("string")
    numbered = {"num", "color"} <= set(after.columns)
    odd = ~(F.col("num").eqNullSafe(F.floor(F.col("i") / 2) + 1) & F.col("color").eqNullSafe(half_of(F.col("i")))) if numbered else F.lit(False)
    named = F.struct(F.col("i"), *((F.col("num"), F.col("color")) if numbered else (F.lit(0).cast("long").alias("num"), F.lit("").alias("color"))))
    b, a = before.select("game_id", "id", F.col("i").alias("bi"), load(before).alias("bp")), after.select("game_id", "id", F.col("i").alias("ai"), load(after).alias("ap"), F.when(odd, named).alias("named"))
    both = b.join(a, ["game_id", "id"], "full_outer")
    w = Window.partitionBy("game_id").orderBy("bi")
    stays = F.col("bi").isNotNull() & F.col("ai").isNotNull()
    both = both.withColumns({"back": F.when(stays, F.max(F.when(stays, F.col("ai"))).over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("ai")), "gone": F.col("ai").isNull(), "new": F.col("bi").isNull(), "changed": stays & ~F.col("bp").eqNullSafe(F.col("ap"))})
    listed = lambda flag, *columns: F.array_sort(F.collect_list(F.when(flag, F.struct(*columns))))
    ids = lambda flag, order: F.transform(listed(flag, F.col(order), F.col("id")), lambda x: x["id"])
    c = both.groupBy("game_id").agg(
        F.coalesce(F.bool_or("back"), F.lit(False)).alias("moved"), F.count_if("gone").alias("n_gone"), F.count_if("new").alias("n_new"), F.count_if("changed").alias("n_changed"), F.count("ai").alias("length"),
        ids(F.col("gone"), "bi").alias("deleted"), listed(F.col("new"), F.col("ai").alias("pos"), F.col("id")).alias("inserted"), ids(F.col("changed"), "ai").alias("updated"), ids(~F.col("gone"), "ai").alias("order"),
        listed((F.col("new") | F.col("changed")) & F.col("ap").isNotNull(), F.col("id"), F.col("ap").alias("payload")).alias("contents"), F.array_sort(F.collect_list("named")).alias("numbers"),
        F.min(F.when(F.col("gone"), F.col("bi")).when(F.col("new") | F.col("changed"), F.col("ai"))).alias("first"), F.min(F.when(F.col("gone"), F.col("bi"))).alias("first_gone"), F.max(F.when(stays, F.col("bi"))).alias("last_kept"),
    )
    gone, new, tail = F.col("n_gone") > 0, F.col("n_new") > 0, F.coalesce(F.col("first_gone") > F.coalesce("last_kept", F.lit(-1)), F.lit(False))
    kind = F.when(F.col("moved"), "realign").when(~gone & ~new, "update").when(gone & ~new & tail & (F.col("n_changed") == 0), "truncate").when(gone & ~new, "duplicate-delete").when(~gone, "gap-insert").otherwise("realign")
    plain = lambda x: F.when(F.col("moved"), F.slice(x, 1, 0)).otherwise(F.col(x)).alias(x)
    changed = c.where("n_gone + n_new + n_changed > 0 or moved")
    return changed.select("game_id", kind.alias("type"), F.coalesce("first", F.lit(0).cast("long")).alias("first"), "length", plain("deleted"), plain("inserted"), "updated", F.when(F.col("moved"), F.col("order")).alias("sequence"), "contents", "numbers")


def capture(before: DataFrame, after: DataFrame) -> DataFrame:
    """captured() as text: (game_id, type, first, length, deleted, inserted, updated, sequence), lists joined by commas, insertions as `position:id`."""
    text = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    inserted = F.array_join(F.transform("inserted", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["id"].cast("string"))), ",")
    return captured(before, after).select("game_id", "type", "first", "length", text("deleted").alias("deleted"), inserted.alias("inserted"), text("updated").alias("updated"), F.coalesce(text("sequence"), F.lit("")).alias("sequence"))


def half_of(i: Column) -> Column:
    return F.when(i % 2 == 0, "w").otherwise("b")


def _applied(state: Column, e: Column) -> Column:
    """State (ids, n, reason) of a game behind an entry: reason is null while all entries fitted, else n is the one that didn't."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    make = lambda ids, n, reason: F.struct(ids.alias("ids"), n.cast("long").alias("n"), reason.cast("string").alias("reason"))
    none = F.lit(None)
    ids, missing = state["ids"], F.array_except(e["deleted"], state["ids"])
    left = F.filter(ids, lambda x: ~F.array_contains(e["deleted"], x))
    put = lambda t, p: F.when(t["past"] | (p["pos"] > F.size(t["ids"])), F.struct(t["ids"].alias("ids"), F.lit(True).alias("past"))).otherwise(
        F.struct(F.concat(F.slice(t["ids"], F.lit(1), p["pos"].cast("int")), F.array(p["id"]), F.slice(t["ids"], p["pos"].cast("int") + 1, F.size(t["ids"]))).alias("ids"), F.lit(False).alias("past"))
    )
    grown = F.when(e["sequence"].isNotNull(), F.struct(e["sequence"].alias("ids"), F.lit(False).alias("past"))).otherwise(F.aggregate(F.array_sort(e["inserted"]), F.struct(left.alias("ids"), F.lit(False).alias("past")), put))
    absent = F.concat(F.lit("deletes absent cell "), F.element_at(missing, 1).cast("string"))
    length = lambda t: F.concat(F.lit("length "), F.size(t["ids"]).cast("string"), F.lit(" is not "), e["length"].cast("string"))
    checked = lambda t: F.when(t["past"], make(ids, e["n"], F.lit("insert past the end"))).when(F.size(t["ids"]) != e["length"], make(ids, e["n"], length(t))).otherwise(make(t["ids"], e["n"], none))
    fits = F.when(e["sequence"].isNull() & (F.size(missing) > 0), make(ids, e["n"], absent)).otherwise(let(grown, checked))
    return F.when(state["reason"].isNotNull(), state).otherwise(fits)


def replay_entries(base: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final cells (game_id, i, id, payload, num, color), rejects (game_id, n, reason)) of base (game_id, i, id, payload) after entries (game_id, n and the columns of captured()), in order of n.

    An entry must delete cells that are there, insert by ascending position not
    past the end, and leave its recorded length (unless that is null); a null
    deleted or inserted list is an empty one. The first that doesn't fit rejects
    its game as a whole and is named, as are entries of a game without cells,
    and the last entry (0 if none) of a game whose final order has a cell
    without content. Contents are the payloads of base and of all entries, a
    later one winning; cells are numbered by place but for the exceptions of the
    last entry. A game's order is folded in one row, JVM-side; contents are
    joined by cell.
    """
    empty = lambda name: F.coalesce(name, F.slice(name, 1, 0), F.from_json(F.lit("[]"), entries.schema[name].dataType))
    step = F.struct("n", "length", empty("deleted").alias("deleted"), empty("inserted").alias("inserted"), "sequence")
    steps = entries.groupBy("game_id").agg(F.array_sort(F.collect_list(step), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)).alias("steps"), F.max_by("numbers", "n").alias("numbers"))
    start = base.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))
    begin = F.struct(F.col("ids"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("reason"))
    none = F.struct(F.col("ids"), F.element_at("steps", 1)["n"].cast("long").alias("n"), F.lit("no cells to begin with").alias("reason"))
    both = start.join(steps, "game_id", "full_outer")
    folded = kept(both.select("game_id", "numbers", F.when(F.col("ids").isNull(), none).when(F.col("steps").isNull(), begin).otherwise(F.aggregate("steps", begin, _applied)).alias("s")))
    cells = folded.where("s.reason is null").select("game_id", "s.n", "numbers", F.posexplode("s.ids").alias("i", "id"))
    given = base.select("game_id", F.lit(None).cast("long").alias("at"), "id", "payload").union(entries.select("game_id", F.col("n").alias("at"), F.explode("contents").alias("x")).select("game_id", "at", "x.id", "x.payload"))
    content = given.where("payload is not null").groupBy("game_id", "id").agg(F.max_by("payload", F.coalesce("at", F.lit(-1))).alias("payload"))
    full = kept(cells.join(content, ["game_id", "id"], "left"))
    short = full.where("payload is null").groupBy("game_id").agg(F.max("n").alias("n"), F.min(F.struct("i", "id")).alias("x"))
    short = short.select("game_id", "n", F.concat(F.lit("no content for cell "), F.col("x.id").cast("string")).alias("reason"))
    named = full.join(short.select("game_id"), "game_id", "left_anti").withColumn("other", F.try_element_at(F.filter("numbers", lambda x: x["i"] == F.col("i")), F.lit(1)))
    final = named.select("game_id", F.col("i").cast("long").alias("i"), "id", "payload", F.coalesce("other.num", F.floor(F.col("i") / 2) + 1).alias("num"), F.coalesce("other.color", half_of(F.col("i"))).alias("color"))
    return final, folded.where("s.reason is not null").select("game_id", "s.n", "s.reason").union(short)
