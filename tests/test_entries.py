"""Captured entries: what they say, and that replaying them leads back; against lists."""

import random

from duoply.operators import align as A

CELLS = "game_id long, i long, id long, payload string, num long, color string"


def snapshot(game, ids, payloads, odd=()):
    return [(game, i, x, payloads[x], 90 if x in odd else i // 2 + 1, "b" if x in odd else "wb"[i % 2]) for i, x in enumerate(ids)]


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def entries_of(spark, saves):
    """Entries between consecutive savings of one or more games: {game: [rows, rows, ...]}."""
    before = [(g * 100 + n, *r[1:]) for g, many in saves.items() for n, rows in enumerate(many[:-1]) for r in rows]
    after = [(g * 100 + n, *r[1:]) for g, many in saves.items() for n, rows in enumerate(many[1:]) for r in rows]
    found = A.captured(frame(spark, before), frame(spark, after))
    return found.selectExpr("game_id % 100 AS n", "cast(floor(game_id / 100) AS long) AS game_id", "type", "first", "length", "deleted", "inserted", "updated", "sequence", "contents", "numbers")


def test_random_histories_lead_back(spark):
    rng, saves = random.Random(9), {}
    for game in range(1, 25):
        ids, new, payloads, history = list(range(rng.randint(1, 12))), 100, {}, []
        payloads = {x: f"p{x}" for x in ids}
        history.append(snapshot(game, ids, payloads))
        for _ in range(rng.randint(1, 5)):
            for _ in range(rng.randint(0, 4)):
                what = rng.random()
                if what < 0.4 or len(ids) < 2:
                    new += 1
                    ids.insert(rng.randint(0, len(ids)), new)
                    payloads[new] = f"n{new}"
                elif what < 0.6:
                    del ids[rng.randrange(len(ids))]
                elif what < 0.8:
                    payloads[rng.choice(ids)] = f"u{rng.randrange(99)}"
                else:
                    rng.shuffle(ids)
            history.append(snapshot(game, ids, payloads, odd={x for x in ids if x % 7 == 3}))
        saves[game] = history
    base = frame(spark, [r for many in saves.values() for r in many[0]])
    final, rejects = A.replay_entries(base.select("game_id", "i", "id", "payload"), entries_of(spark, saves))
    assert rejects.count() == 0
    want = []
    for g, many in saves.items():
        same = [(r[2], r[3]) for r in many[-2]] == [(r[2], r[3]) for r in many[-1]]
        want += [r for r in many[-1]] if not same else []
    got = sorted(map(tuple, final.collect()))
    still = {g for g, many in saves.items() if [(r[2], r[3]) for r in many[-2]] == [(r[2], r[3]) for r in many[-1]]}
    assert [r for r in got if r[0] not in still] == sorted(want)
    assert [r[:4] for r in got if r[0] in still] == sorted(r[:4] for g in still for r in saves[g][-1])


def entry(n, **more):
    row = {"game_id": 1, "n": n, "type": "", "first": 0, "length": None, "deleted": [], "inserted": [], "updated": [], "sequence": None, "contents": [], "numbers": []}
    return row | more


ENTRY = "game_id long, n long, type string, first long, length long, deleted array<long>, inserted array<struct<pos: long, id: long>>, updated array<long>, sequence array<long>, contents array<struct<id: long, payload: string>>, numbers array<struct<i: long, num: long, color: string>>"


def replayed(spark, ids, *rows, base_game=1):
    base = spark.createDataFrame([(base_game, i, x, "p") for i, x in enumerate(ids)], "game_id long, i long, id long, payload string")
    final, rejects = A.replay_entries(base, spark.createDataFrame([tuple(r.values()) for r in rows], ENTRY))
    return [tuple(r)[1:] for r in final.orderBy("game_id", "i").collect()], [tuple(r) for r in rejects.collect()]


def test_rules_of_entries(spark):
    put = lambda pos, i: {"inserted": [(pos, i)], "contents": [(i, "new")]}
    assert replayed(spark, [1, 2], entry(1, **put(2, 3), length=3)) == ([(0, 1, "p", 1, "w"), (1, 2, "p", 1, "b"), (2, 3, "new", 2, "w")], [])
    assert replayed(spark, [1, 2], entry(1, **put(3, 3)))[1] == [(1, 1, "insert past the end")]
    assert replayed(spark, [1, 2], entry(2, deleted=[2]), entry(1, deleted=[7]))[1] == [(1, 1, "deletes absent cell 7")]
    assert replayed(spark, [1, 2], entry(1, deleted=[1], length=2))[1] == [(1, 1, "length 1 is not 2")]
    assert replayed(spark, [1], entry(1, inserted=[(0, 5)], length=2), entry(2))[1] == [(1, 2, "no content for cell 5")]
    assert replayed(spark, [1], entry(4), base_game=2)[1] == [(1, 4, "no cells to begin with")]
    # deletes come before inserts, inserts by position, null lists are empty, an id may come back, the last content wins
    final, rejects = replayed(spark, [1, 2, 3], entry(1, deleted=[2], inserted=[(2, 9), (0, 8)], contents=[(8, "a"), (9, "b")], length=4), entry(2, deleted=None, inserted=[(0, 2)], contents=[(8, "c")], numbers=[(1, 7, "b")]))
    assert rejects == [] and final == [(0, 2, "p", 1, "w"), (1, 8, "c", 7, "b"), (2, 1, "p", 2, "w"), (3, 9, "b", 2, "b"), (4, 3, "p", 3, "w")]
    assert replayed(spark, [1, 2, 3], entry(1, sequence=[3, 1], deleted=[99], length=2))[0] == [(0, 3, "p", 1, "w"), (1, 1, "p", 1, "b")]


def test_no_rows(spark):
    base = spark.createDataFrame([(1, 0, 5, "p")], "game_id long, i long, id long, payload string")
    none = spark.createDataFrame([], ENTRY)
    final, rejects = A.replay_entries(base, none)
    assert [tuple(r) for r in final.collect()] == [(1, 0, 5, "p", 1, "w")] and rejects.count() == 0
    assert A.replay_entries(base.limit(0), none)[0].count() == 0


def test_one_replay_gives_all_savings(spark):
    log = [(g, s, "delete" if s % 4 == 0 else "insert", 0, 10 * g + s, [k for k in (1, 2, 3) if s == 2 * k]) for g in (1, 2) for s in range(1, 7)]
    log.append((2, 7, "insert", 99, 0, []))  # rejects its game, savings and all
    final, rejects = A.replay(spark.createDataFrame(log[::-1], "game_id long, seq long, op string, pos long, event_id long, saves array<long>"))
    want = [(1, 1, [12, 11]), (1, 2, [12, 11]), (1, 3, [16, 15, 12, 11])]
    got = sorted(map(tuple, final.select("game_id", "save", "i", "id").collect()))
    assert got == [(g, k, i, x) for g, k, ids in want for i, x in enumerate(ids)]
    assert [tuple(r) for r in rejects.collect()] == [(2, 7, "insert past the end")]
