"""Worked examples, round trips, brute force and properties of the sequence operators."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoply import fixtures, plans
from duoply.functions import moves as M
from duoply.functions import records as R
from duoply.functions import similarity as S
from duoply.operators import align as A
from duoply.operators import detect as D
from duoply.operators import evidence as E
from duoply.operators import link as L
from duoply.operators import reconcile as J
from duoply.plans import sequences
from duoply.sources import games as G

SF = "/root/testdata/sf0.001"


def candidates(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "game_id long, sheet int, ply long, rk int, move string, conf double")


def merged(spark, rows):
    return {r.ply: r for r in J.merge(candidates(spark, rows)).collect()}


def column(spark, fn, values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(fn(F.col("v")).alias("x")).collect()]


def test_moves(spark):
    assert column(spark, M.normalize_move, ["Nf3+", " 0-0-0 ", "0-0#", None]) == ["Nf3", "O-O-O", "O-O", ""]
    p = column(spark, M.parse_move, ["Nbxd7", "e8=Q+", "Pf4", "cd", "O-O", "??", None])
    assert (p[0].piece, p[0].target, p[0].capture) == ("N", "d7", True) and p[1].promo == "Q" and p[2].target == "f4"
    assert p[3].file == "d" and p[3].rank is None and p[4].castle == "O-O" and p[5] is None and p[6] is None
    assert column(spark, M.is_truncated, ["Nf3", "N", "???", "", None]) == [False, True, True, True, True]
    assert column(spark, M.notation_class, ["Nf3", "e2e4", "e8=Q", "O-O", "0-0", "Pf4", "cd", "ch", "NxB", "e4xd5", "e2-e4", "zz"]) == ["standard", "long", "promotion", "castling", "zero_castling", "pawn_prefix", "file_capture", "invalid", "piece_takes_piece", "square_takes_square", "dash", "invalid"]
    assert column(spark, M.label_ply, ["12.B", "1.w", "x"]) == [23, 0, None]
    assert column(spark, M.checksum, ["abc"]) == ["1a47e90b"]
    assert column(spark, lambda c: M.normalize_move(M.normalize_move(c)), ["O-O+", "0-0-0"]) == ["O-O", "O-O-O"]


def test_records(spark):
    s = column(spark, R.scan_name, ["OpenR1B4p1.jpg", "b3p2.jpg", "IMG_0001.jpg", "scoresheet_p1.jpg"])
    assert (s[0].section, s[0].round, s[0].board, s[0].page) == ("Open", 1, 4, 1) and (s[1].board, s[1].page) == (3, 2) and s[2] is None and s[3] is None
    p = column(spark, R.scan_path, ["All/Open/Round 1/Board 1/x.pdf"])[0]
    assert (p.section, p.round, p.board) == ("Open", 1, 1)
    assert column(spark, R.normalize_result, ["1 - 0", "½-½", None, "odd"]) == ["1-0", "1/2-1/2", "*", "odd"]


def test_consensus_of_two_sheets(spark):
    r = merged(spark, [(1, 0, 0, "Bb7", 0.719), (2, 0, 0, "Nb7", 0.618), (2, 0, 1, "Bb7", 0.321)])[0]
    assert r.move == "Bb7" and r.consensus and r.conf == pytest.approx(1.04) and not r.ambiguous


def test_near_ties_stop_only_strong_readings(spark):
    rows = merged(spark, [(1, 0, 0, "Qb8", 0.557), (2, 0, 0, "Rb8", 0.527), (1, 1, 0, "Nf3", 0.2), (2, 1, 0, "Nf6", 0.2), (1, 2, 0, "e4", 0.5)])
    assert rows[0].ambiguous and not rows[1].ambiguous and rows[2].sheet_count == 1 and rows[2].move == "e4"


def test_unreliable_reader(spark):
    tops = [(s, p, 0, "e4" if p < 3 or s == 1 else "d5", 0.9) for p in range(8) for s in (1, 2)]
    r = J.reliability(candidates(spark, tops)).first()
    assert r.n == 8 and r.rate == pytest.approx(0.375) and r.unreliable


def overlaps(spark, values):
    return spark.createDataFrame([(1, p, float(v)) for p, v in enumerate(values)], "game_id long, ply long, overlap double")


def test_isolated_dropout(spark):
    trace = [1.0, 0.95, 1.005, 1.239, 0, 0, 1.937, 1.995, 1.970, 1.999]
    assert [r.start for r in D.isolated_dropout(overlaps(spark, trace)).collect()] == [4]
    assert D.isolated_dropout(overlaps(spark, [2, 2, 2, 2, 0, 2, 2, 2, 2])).count() == 0
    assert D.overlap_drop(overlaps(spark, trace)).count() == 0


def test_attention_limit_is_inclusive(spark):
    rows = spark.sql("SELECT 1L operator_id, timestamp_seconds(x) ts, 'g' open_game, x event_id FROM VALUES (0L), (120L), (241L) t(x)")
    assert D.attention(rows).first().seconds == 120


def test_link_by_offset_and_order(spark):
    pairs = spark.createDataFrame([(i, "S", 1, 42 + i, f"w{i}", f"b{i}") for i in range(3)], "pairing_id long, section string, round long, board long, white_name string, black_name string")
    games = spark.createDataFrame([(10 + i, "S", 1, i + 1) for i in range(3)], "game_id long, section string, round long, board long")
    assert {(r.game_id, r.pairing_id, r.how) for r in L.match_games(games, pairs).collect()} == {(10, 0, "offset"), (11, 1, "offset"), (12, 2, "offset")}
    none = L.match_games(games, pairs).where("false")
    assert {(r.game_id, r.pairing_id) for r in L.attach_by_order(games, pairs, none).collect()} == {(10, 0), (11, 1), (12, 2)}
    assert L.attach_by_order(games.where("board < 3"), pairs, none).count() == 0


def test_pairings_without_numbers_stay_apart(spark):
    rows = spark.createDataFrame([(1, "S", 1, None, None, 5, "1-0", "a"), (2, "S", 1, None, None, 6, "0-1", "a"), (3, "S", 1, 7, 8, None, "1-0", "a"), (4, "S", 1, 8, 7, 9, "*", "b")], "pairing_id long, section string, round long, white_sno long, black_sno long, board long, result string, source string")
    got = L.merge_sources(rows).collect()
    assert len(got) == 3 and {(r.low_no, r.board, r.result) for r in got} == {(None, 5, "1-0"), (None, 6, "0-1"), (7, 9, "1-0")}


def brute_alignment(score, gap=-0.3, bias=-0.05):
    best = {(0, 0): 0.0}
    for i in range(score.shape[0] + 1):
        for j in range(score.shape[1] + 1):
            ways = [best[i - 1, j] + gap] if i else []
            ways += [best[i, j - 1] + gap] if j else []
            ways += [best[i - 1, j - 1] + score[i - 1, j - 1] + bias] if i and j else []
            best[i, j] = max(ways, default=0.0)
    return best[score.shape]


def test_alignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        score = rng.random((rng.integers(0, 8), rng.integers(0, 8))).round(2)
        path = A.global_alignment(score)
        got = sum(score[i, j] - 0.05 if k == "match" else -0.3 for k, i, j in path)
        assert got == pytest.approx(brute_alignment(score))
        assert [i for _, i, _ in path if i >= 0] == list(range(score.shape[0])) and [j for _, _, j in path if j >= 0] == list(range(score.shape[1]))


def test_ctc_scores_equal_all_alignments():
    rng = np.random.default_rng(3)
    for frames, symbols in ((5, 4), (4, 7)):
        texts = ["a", "ab", "aa", "abc", "", "ba", "aba", "xyz", "aaaa", "g", "aab"]
        logp = E.log_frames(rng.normal(size=(len(texts), frames * symbols)) * 2, frames, symbols)
        best, total = E.ctc_scores(logp, texts)
        for k, text in enumerate(texts):
            paths = []
            for p in itertools.product(range(symbols), repeat=frames):
                if "".join(E.LETTERS[s - 1] for s, _ in itertools.groupby(p) if s) == text:
                    paths.append(sum(logp[k, t, s] for t, s in enumerate(p)))
            assert np.isnan(best[k]) and np.isnan(total[k]) if not paths else best[k] == pytest.approx(max(paths)) and total[k] == pytest.approx(np.logaddexp.reduce(paths))


def test_scores_of_mixed_shapes(spark):
    cells = spark.createDataFrame([(1, 2, 3, [1.0, 2.0, 0.0, 0.0, 1.0, 3.0]), (2, 3, 2, [0.0, 1.0] * 3), (3, 2, 3, [1.0]), (4, 2, 3, None)], "cell long, frames int, symbols int, values array<float>").where("values is not null")
    asked = spark.createDataFrame([(1, "a"), (1, "ab"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (2, None), (9, "a")], "cell long, text string")
    got = {(r.cell, r.text): r.best for r in E.score_candidates(cells, asked).collect()}
    lse = lambda *x: np.log(np.exp(x).sum())
    assert got.pop((1, "ab")) == pytest.approx(2 - lse(1, 2, 0) + 3 - lse(0, 1, 3)) and got.pop((2, "a")) == pytest.approx(3 * (1 - lse(0, 1)))
    assert got.pop((1, "a")) is not None and got == {(1, "c"): None, (2, "b"): None, (3, "a"): None}


def test_replay_and_capture(spark):
    rng = random.Random(2)
    rows, ids, bad = [], [], 0
    first_bad, then = None, []
    for seq in range(1, 60):
        op, pos = rng.choice(["insert", "insert", "delete"]), rng.randint(0, 12)
        rows.append((1, seq, op, pos, 100 + seq))
        if first_bad is None:
            then = list(ids)
        if op == "insert" and pos <= len(ids):
            ids.insert(pos, 100 + seq)
        elif op == "delete" and pos < len(ids):
            del ids[pos]
        else:
            bad += 1
            first_bad = first_bad or seq
    e = spark.createDataFrame(rows, "game_id long, seq long, op string, pos long, event_id long")
    final, rejects = A.replay(e)
    assert final.count() == 0 and rejects.first().seq == first_bad
    good = [r for r in rows if r[1] < first_bad]
    final, rejects = A.replay(spark.createDataFrame(good, e.schema))
    found = final.orderBy("i").collect()
    assert [r.id for r in found] == then and rejects.count() == 0 and [(r.num, r.color) for r in found] == [(i // 2 + 1, "wb"[i % 2]) for i in range(len(then))]
    wrong = spark.createDataFrame([(1, 1, "insert", 0, 5, 1), (1, 2, "insert", 0, 6, 3)], "game_id long, seq long, op string, pos long, event_id long, length long")
    assert A.replay(wrong)[1].first().reason == "length 2 is not 3"


def test_capture_and_its_types(spark):
    snap = lambda xs, more="": spark.createDataFrame([(1, i, x, f"p{x}{more}") for i, x in enumerate(xs)], "game_id long, i long, id long, payload string")
    kinds = {"truncate": ([1, 2, 3], [1, 2]), "duplicate-delete": ([1, 2, 3], [1, 3]), "gap-insert": ([1, 3], [1, 2, 3]), "realign": ([1, 2, 3], [2, 1, 3])}
    for kind, (a, b) in kinds.items():
        assert A.capture(snap(a), snap(b)).first().type == kind
    assert A.capture(snap([1]), snap([1])).count() == 0
    r = A.capture(snap([1, 2]), snap([1, 2], "!")).first()
    assert (r.type, r.updated, r.first) == ("update", "1,2", 0)
    r = A.capture(snap([1, 2, 3, 4]), snap([1, 7, 3, 8, 4])).first()
    assert (r.type, r.deleted, r.inserted, r.sequence, r.length, r.first) == ("realign", "2", "1:7,3:8", "", 5, 1)
    r = A.capture(snap([1, 2, 3]), snap([3, 9, 1])).first()
    assert (r.type, r.deleted, r.inserted, r.sequence) == ("realign", "", "", "3,9,1")
    # the entry leads from one snapshot to the other
    rng = random.Random(8)
    for _ in range(5):
        a = rng.sample(range(40), 20)
        b = [x for x in a if rng.random() < 0.8]
        for x in rng.sample(range(100, 140), 4):
            b.insert(rng.randint(0, len(b)), x)
        r = A.capture(snap(a), snap(b)).first()
        gone = set(map(int, r.deleted.split(","))) if r.deleted else set()
        ids = [x for x in a if x not in gone]
        for place, x in (map(int, p.split(":")) for p in r.inserted.split(",")):
            ids.insert(place, x)
        assert ids == b and r.length == len(b)


MOVES = [f"{'NBRQ'[i % 4]}{'abcdefgh'[i * 5 % 8]}{i * 3 % 8 + 1}" for i in range(60)]


def readings(spark, one, two):
    """Candidates of one game from two lists of moves, all sure, with one alternative each that differs between sheets."""
    rows = [(1, s + 1, p, rk, m if rk == 0 else f"{'ab'[s]}{p % 8 + 1}", 0.95 if rk == 0 else 0.05) for s, moves in enumerate((one, two)) for p, m in enumerate(moves) for rk in (0, 1)]
    return spark.createDataFrame(rows, "game_id long, sheet int, ply long, rk int, move string, conf double")


def found(df):
    return [(r.direction, r.action, r.sheet, r.at, r.n, r.plies) for r in df.orderBy("place", F.desc("direction")).collect()]


def test_gap_suggestions_of_missing_and_superfluous_plies(spark):
    lacks = readings(spark, MOVES, MOVES[:20] + MOVES[22:])
    assert found(A.gap_suggestions(lacks)) == [("primary", "delete", 1, 20, 2, "20,21"), ("inverse", "insert", 2, 20, 2, "")]
    extra = readings(spark, MOVES, MOVES[:30] + ["h7", "h8", "h1"] + MOVES[30:])
    assert found(A.gap_suggestions(extra)) == [("primary", "insert", 1, 30, 3, ""), ("inverse", "delete", 2, 30, 3, "30,31,32")]
    misread = readings(spark, MOVES, MOVES[:15] + ["Kh8"] + MOVES[16:])
    assert found(A.gap_suggestions(misread)) == []
    single = readings(spark, MOVES, MOVES[:25] + MOVES[26:])
    assert found(A.gap_suggestions(single))[0] == ("primary", "delete", 1, 25, 1, "25")


def test_cascade_finds_one_fault_after_another(spark):
    twice = MOVES[:12] + MOVES[10:12] + MOVES[12:40] + MOVES[42:]
    rows = found(A.cascade(readings(spark, MOVES, twice)))
    assert ("primary", "delete_duplicate", 2, 12, 2, "12,13") in rows
    assert found(A.cascade(readings(spark, MOVES, MOVES))) == [] and found(A.cascade(readings(spark, MOVES, MOVES[:40]))) == []
    tail = found(A.cascade(readings(spark, MOVES, MOVES[:56] + MOVES[57:])))
    assert tail[:1] == [("primary", "delete", 1, 56, 1, "56")]


def test_auto_apply_goes_on_until_nothing_is_left(spark):
    c = readings(spark, MOVES, MOVES[:10] + MOVES[12:24] + MOVES[26:40] + MOVES[42:])
    log = A.auto_apply(c, threshold=0.5)
    steps = [(r.action, r.sheet, r.at, r.n) for r in log.orderBy("place").collect()]
    assert steps == [("delete", 1, 10, 2), ("delete", 1, 22, 2), ("delete", 1, 36, 2)]
    sheet = lambda df, s: [r.move for r in df.where(F.col("sheet") == s).orderBy("ply").collect()]
    done = A.edited_cells(c, log)
    assert sheet(done, 1) == sheet(done, 2) == MOVES[:10] + MOVES[12:24] + MOVES[26:40] + MOVES[42:]
    assert sheet(A.edited_cells(c, log, before=1), 1) == MOVES[:10] + MOVES[12:] and sheet(A.edited_cells(c, log, before=0), 1) == MOVES
    assert A.auto_apply(c).count() == 0
    inserted = A.edited_cells(readings(spark, MOVES[:10], MOVES[:10]), spark.createDataFrame([(1, 0, "insert", 2, 4, 2, "", 1.0, 1.0)], A.APPLIED))
    assert sheet(inserted, 2) == MOVES[:4] + ["???"] * 2 + MOVES[4:10]


def test_shift_suggestions(spark):
    c = readings(spark, MOVES, MOVES[:20] + MOVES[22:])
    offsets = A.running_offset(c).collect()
    assert [(r.before, r.offset, r.delta) for r in offsets] == [(0, -2, -2)]
    rows = A.shift_suggestions(c, A.running_offset(c), A.repeated_rows(c)).orderBy("priority").collect()
    assert [(r.cause, r.sheet, r.action, r.confidence) for r in rows] == [("shift_2", 1, "delete", "medium"), ("shift_2", 2, "insert_pair", "low")]
    twice = readings(spark, MOVES[:12] + MOVES[10:12] + MOVES[12:], MOVES)
    rows = A.shift_suggestions(twice, A.running_offset(twice), A.repeated_rows(twice)).collect()
    assert [(r.cause, r.sheet, r.action, r.move) for r in rows] == [("repeat", 1, "delete", 7)]
    assert A.shift_suggestions(readings(spark, MOVES[:4], MOVES[:4]), A.running_offset(c), A.repeated_rows(twice)).count() == 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def many_games(spark, n):
    """Games with a gap of their own each, as readings(), in one frame."""
    df = readings(spark, MOVES, MOVES[:20] + MOVES[22:]).withColumn("game_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    return df.where(~((F.col("game_id") % 2 == 0) & (F.col("sheet") == 2)))


@pytest.mark.parametrize("rows", [1, 7, 100, 10000])
def test_offset_windows_shuffle_once_whatever_the_batches(spark, rows):
    c = many_games(spark, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        moved = A.running_offset(c)
        assert shuffles(A.offset_windows(c)) == 1
        assert sorted((r.game_id, r.before, r.offset) for r in moved.collect()) == [(g, 0, -2) for g in range(1, 12, 2)]
        assert A.offset_windows(c).groupBy("game_id").count().select("count").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_cells_near_equal_tops_are_compared_for_repeats(spark, monkeypatch):
    counts, kept = [], A.kept
    monkeypatch.setattr(A, "kept", lambda df: counts.append((out := kept(df)).count()) or out)
    twice = readings(spark, MOVES[:12] + MOVES[10:12] + MOVES[12:], MOVES)
    assert [(r.sheet, r.at, r.kind) for r in A.repeated_rows(twice).collect()] == [(1, 10, "exact")]
    alike = sum(a == b for moves in (MOVES[:12] + MOVES[10:12] + MOVES[12:], MOVES) for a, b in zip(moves[::2], moves[2::2]))
    assert len(counts) == 1 and 8 <= counts[0] <= 8 * alike < twice.count() / 2


@pytest.mark.parametrize("rows", [1, 7, 10000])
def test_replay_takes_many_games_a_batch(spark, rows):
    log = [(g, s, "insert", 0, 10 * s) for g in range(1, 30) for s in range(1, 1 + g % 5)] + [(30, 1, "delete", 0, 1), (None, 2, "insert", 1, 8), (None, 1, "insert", 0, 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        final, rejects = A.replay(spark.createDataFrame(log, "game_id long, seq long, op string, pos long, event_id long"))
        assert "MapInArrow" in final._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in final.orderBy("i").collect():
            got.setdefault(r.game_id, []).append(r.id)
        assert got == {g: [10 * s for s in range(g % 5, 0, -1)] for g in range(1, 30) if g % 5} | {None: [7, 8]}
        assert [tuple(r) for r in rejects.collect()] == [(30, 1, "delete past the end")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_decode(logp, pattern):
    """Every path of symbols, collapsed."""
    best = {}
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        text = "".join(E.LETTERS[s - 1] for k, s in enumerate(path) if s and (k == 0 or path[k - 1] != s))
        p = sum(logp[k][s] for k, s in enumerate(path))
        if text and re.fullmatch(pattern, text):
            best[text] = max(best.get(text, -99.0), p)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_decoding_against_all_paths():
    """A beam that drops nothing, over grammars, all cells at once."""
    rng = np.random.default_rng(3)
    logp = E.log_frames(rng.normal(size=(5, 4 * 8)) * 3, 4, 8)
    for shapes, pattern in (([[("abcdefg", 0, 9)]], "[a-g]*"), ([[("abc", 1, 1), ("defg", 0, 2)], [("ag", 2, 3)]], "[a-c][d-g]{0,2}|[ag]{2,3}"), ([[("a", 0, 1), ("b", 0, 1), ("a", 1, 1)]], "a?b?a"), ([[("z", 1, 1)]], "z")):
        cell, place, text, conf, whole = E.readings(logp, E.Grammar(shapes), most=20, width=4000)
        for c in range(5):
            want = brute_decode(logp[c], pattern)[:20]
            rows = [k for k in range(len(cell)) if cell[k] == c and whole[k]]
            assert [text[k] for k in rows] == [t for t, _ in want] and [place[k] for k in rows] == list(range(len(want)))
            p = np.exp([s for _, s in want])
            assert np.allclose(conf[rows], p / p.sum()) if want else [(text[k], conf[k]) for k in range(len(cell)) if cell[k] == c] == [("", 0.0)]


def plain_beam(logp, shapes, width):
    """One cell with a dictionary, pruned by a regular expression."""
    import regex

    pattern = regex.compile("|".join("".join(f"[{c}]{{{a},{b}}}" for c, a, b in shape) for shape in shapes))
    beam = {("", 0): 0.0}
    for row in logp:
        new = {}
        for (text, last), p in beam.items():
            for s in range(len(row)):
                key = (text, s) if s in (0, last) else (text + E.LETTERS[s - 1], s)
                if key[0] == text or pattern.fullmatch(key[0], partial=True):
                    new[key] = max(new.get(key, -np.inf), p + row[s])
        beam = dict(sorted(new.items(), key=lambda x: (-round(x[1], 9), x[0]))[:width])
    return list(beam.items())


def test_narrow_beams_keep_what_a_plain_one_keeps():
    rng = np.random.default_rng(4)
    shapes = [[("abc", 1, 1), ("bcdef", 0, 4)], [("ef", 2, 2), ("abcdefg", 1, 9)]]
    scores = rng.normal(size=(40, 9 * 8)) * 2
    scores[:10] = np.round(scores[:10])  # ties
    logp = E.log_frames(scores, 9, 8)
    for width in (1, 3, 15):
        text, state, score, texts = E.beam_search(logp, E.Grammar(shapes), width)
        for c in range(len(logp)):
            want = plain_beam(logp[c], shapes, width)
            live = np.isfinite(score[c])
            assert texts.strings(text[c][live], E.LETTERS) == [t for (t, _), _ in want] and np.allclose(score[c][live], [p for _, p in want])


def test_logits_from_files(spark, tmp_path):
    cells = [("a", c, [float(c + k / 64) for k in range(64)]) for c in range(3)] + [("b", c, [float(-c)] * 64) for c in range(4)] + [("c", 0, [0.5] * 64)]
    frame = spark.createDataFrame(cells, "file string, cell long, values array<double>")
    blobs = G.encode_logits(frame).select(F.concat("file", F.lit(".logits")).alias("path"), "content")
    assert G.scatter(blobs, str(tmp_path / "in")) == 3
    (tmp_path / "in" / "short.logits").write_bytes(b"\x09\x00\x00\x00")
    readings = spark.createDataFrame([(1, 1, "a", c, c) for c in range(3)] + [(1, 2, "b", c, c + 2) for c in range(4)] + [(2, 1, "c", c, c) for c in range(2)], "game_id long, sheet int, file string, cell long, ply long")
    got = {(r.game_id, r.ply): (r.sheet, r["values"][1]) for r in G.logits_by_ply(G.read_logits(spark, str(tmp_path / "in")), readings).collect()}
    assert got == {(1, p): (1, pytest.approx(p + 1 / 64, abs=1e-2)) for p in range(3)} | {(1, p): (2, float(2 - p)) for p in range(3, 6)}


def test_tail_noise_of_one_colour(spark):
    rows = [(1, 1, p, "Nf3" if p < 6 else ("f4" if p % 2 == 0 else f"N{'abcdefgh'[p % 8]}{p % 8 + 1}"), 0.95) for p in range(14)]
    t = spark.createDataFrame(rows, "game_id long, sheet int, ply long, move string, conf double")
    assert D.tail_noise(t).first().start == 6
    quiet = [(1, 1, p, ["a4", "b4", "c4", "d4"][p // 2] if p % 2 == 0 else f"B{'abcdefgh'[p]}5", 0.95) for p in range(8)]
    assert D.tail_noise(spark.createDataFrame(quiet, t.schema)).count() == 0


def test_similarity(spark):
    pairs = [("Nf3", "Nf3"), ("Nf3+", "Nf3"), ("O-O", "Kg1"), ("Nf3", "Rf3"), ("Nf3", "Nf8"), ("ag", "ga")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(S.structured(F.col("a"), F.col("b")).alias("s"), S.positional(F.col("a"), F.col("b")).alias("p")).collect()
    assert rows[0].s == 1.0 and rows[1].s == pytest.approx(0.85) and rows[2].s == pytest.approx(0.1)
    assert rows[3].s == pytest.approx(0.8 + 0.15 * 0.1) and rows[4].s == pytest.approx(0.85 + 0.15 * 0.5) and rows[5].p == pytest.approx(24.0)


@pytest.mark.parametrize("name", ["jn01_merge_two_readings", "win02_tail_noise_simple", "jn02_pool_alternatives"])
def test_partitioning_changes_nothing(spark, name, monkeypatch):
    from duoply.plans import readings

    f = plans.QUERIES[name]
    want = sorted(map(tuple, f(spark, SF).collect()))
    original = fixtures.view
    monkeypatch.setattr(readings, "view", lambda *a: original(*a).repartition(17))
    assert sorted(map(tuple, f(spark, SF).collect())) == want


def test_queens_that_part_stop_a_merge(spark):
    """Which texts are queens on different squares, as parse_move() says, without parsing every move."""
    texts = ["Qd4", "Qxd5", "Qd5", "Qad5+", "Q1xd5", "Qa1d5=Q", "Qd5Q", "Qd", "Q", "qd5", "QQd5", "Qd55", "Kd4", "d4", None, "Qh8#", "O-O", " Qd6 "]
    pairs = [(g, *ab) for g, ab in enumerate(itertools.product(texts, texts))]
    cells = spark.createDataFrame([(g, s, 0, 0, m, c) for g, x, y in pairs for s, m, c in ((1, x, 0.95), (2, y, 0.5))], "game_id long, sheet int, ply long, rk int, move string, conf double")
    a, b = M.parse_move(F.col("a")), M.parse_move(F.col("b"))
    want = {r.g for r in spark.createDataFrame(pairs, "g long, a string, b string").where((a["piece"] == "Q") & (b["piece"] == "Q") & (a["target"] != b["target"])).collect()}
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        merged = J.merge(cells)
        assert M.FILE_CAPTURE not in merged._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    assert len(want) > 20 and {r.game_id for r in merged.where("ambiguous").collect()} == want


def test_suggestions_score_the_offsets_once(spark):
    """Shifts by a full move that rows repeated on the sheet ahead explain go, all others stay, from one pass over the cells."""
    cells = spark.range(1, 4).selectExpr("id AS game_id", "explode(sequence(0L, 9L)) AS ply").selectExpr("game_id", "explode(array(1, 2)) AS sheet", "ply", "0 AS rk", "'e4' AS move", "0.9D AS conf")
    moved = lambda c: A.running_offset(c).select("game_id", F.lit(8).cast("long").alias("start"), F.lit(0.9).alias("at_best"), "delta")
    repeats = spark.createDataFrame([(1, 2, 4), (2, 1, 4)], "game_id long, sheet int, at long")
    assert A.shift_suggestions(cells, moved(cells), repeats)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    offsets = spark.createDataFrame([(g, 8, d, 0.9) for g in (1, 2, 3) for d in (2, 4)] + [(1, 10, -2, 0.9), (2, 10, -2, 0.9)], "game_id long, start long, delta long, at_best double")
    got = sorted((r.game_id, r.cause, r.sheet, r.action) for r in A.shift_suggestions(cells, offsets, repeats).where("cause = 'shift_2'").collect())
    row = lambda game, ahead: [(game, "shift_2", ahead, "delete"), (game, "shift_2", 3 - ahead, "insert_pair")]
    assert got == sorted(row(1, 1) + row(2, 2) + row(3, 2))


def test_captured_edits_reach_the_end_of_each_game(spark):
    """Applied by hand, edit by edit: what the last tenth of the edits removed and added."""
    games, want = {}, {}
    for r in sequences.log(spark, SF).orderBy("game_id", "seq").collect():
        games.setdefault(r.game_id, []).append(r)
    for game, edits in games.items():
        ids, shots = [], {0: []}
        if game % 10 in (7, 8):  # refused as a whole
            continue
        for r in edits:
            if r.op == "insert":
                ids.insert(r.pos, r.event_id)
            else:
                del ids[r.pos]
            assert len(ids) == r.length
            shots[r.seq] = list(ids)
        before = shots[len(edits) - -(-len(edits) // 10)]
        want[game] = ",".join(str(x) for x in before if x not in ids), ",".join(f"{i}:{x}" for i, x in enumerate(ids) if x not in before)
    got = {r.game_id: (r.deleted, r.inserted) for r in plans.QUERIES["seq07_capture_edits"](spark, SF).collect()}
    assert want and got == {g: w for g, w in want.items() if any(w) or g in got}
