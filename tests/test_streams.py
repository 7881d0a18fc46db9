"""Live jobs against plain loops, with rows out of order, repeated and late, one file a micro-batch."""

import random
from collections import Counter

from duoply.operators.review import triage
from duoply.streaming import jobs


def stream(spark, tmp_path, batches, schema):
    """A stream that gives each list of rows as one micro-batch, in order."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/stage{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        name = next(f for f in os.listdir(f"{tmp_path}/stage{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/stage{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_attention_out_of_order_late_and_forgotten(spark, tmp_path):
    at = lambda s: f"2024-05-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    batches = [
        [(1, at(100), "b", 2), (1, at(40), "a", 1), (2, at(10), "x", 9)],
        [(1, at(70), "c", 3), (2, at(60), "y", 10)],  # goes between the two above
        [(1, at(4000), "d", 4), (2, at(4030), "z", 11)],  # moves the watermark past all of these
        [(9, at(4040), "end", 98)],
        [(1, at(90), "late", 5), (1, at(4010), "e", 6)],  # the first is dropped: the watermark has passed it
        [(9, at(30000), "end", 99)],
        [(1, at(30060), "f", 7), (9, at(60000), "end", 100)],
        [(9, at(80000), "end", 101)],
    ]
    rows = stream(spark, tmp_path, [[(o, t, g, e) for o, t, g, e in b] for b in batches], "operator_id long, ts string, open_game string, event_id long")
    got = jobs.drained(jobs.attention(rows.selectExpr("operator_id", "cast(ts as timestamp) AS ts", "open_game", "event_id"), seconds=60, late="10 minutes"), str(tmp_path / "run"))
    assert sorted((r.operator_id, r.open_game, r.seconds) for r in got.collect()) == [(1, "a", 30.0), (1, "c", 30.0), (1, "d", 10.0), (2, "x", 50.0)]


def test_edits_wait_for_their_turn(spark, tmp_path):
    rng = random.Random(4)
    log = [(g, s, rng.choice(["insert", "insert", "delete"]), rng.randrange(6), 100 * g + s) for g in range(6) for s in range(1, 30)]
    ids: dict = {g: [] for g in range(6)}
    want = []
    for g, s, op, pos, new in log:
        ok = pos <= len(ids[g]) if op == "insert" else pos < len(ids[g])
        if ok and op == "insert":
            ids[g].insert(pos, new)
        elif ok:
            del ids[g][pos]
        want.append((g, s, ok, len(ids[g])))
    mixed = log[:]
    rng.shuffle(mixed)
    batches = [mixed[:60], mixed[60:90] + mixed[:20], mixed[90:]]  # some twice
    rows = stream(spark, tmp_path, batches, "game_id long, seq long, op string, pos long, event_id long")
    got = jobs.drained(jobs.edits(rows), str(tmp_path / "run")).drop("_batch")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_totals_after_each_batch_follow_the_latest_status(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randrange(20), rng.choice("ABC"), f"{rng.randrange(1000):04d}") for _ in range(40)] for _ in range(4)]
    got = jobs.status_totals(stream(spark, tmp_path, batches, "game_id long, status string, seq string"), str(tmp_path / "run"))
    latest: dict = {}
    for n, rows in enumerate(batches):
        for g, status, seq in rows:
            if g not in latest or seq > latest[g][0]:
                latest[g] = (seq, status)
        want = Counter(s for _, s in latest.values())
        assert {r.status: r.games for r in got.where(f"_batch = {n} and games > 0").collect()} == want


def test_triage_reads_only_the_games_of_a_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = "game_id long, method string, ply long, san string, similarity double, status string"
    row = lambda g: (g, rng.choice(["greedy", "beam", "dijkstra"]), rng.randrange(6), rng.choice(["Nf3", None]), rng.random(), rng.choice(["SOLVED", "SOLVED", "VALID"]))
    batches = [[row(rng.randrange(lo, lo + 5)) for _ in range(25)] for lo in (0, 3, 6)]
    got = jobs.retriaged(stream(spark, tmp_path, batches, schema), str(tmp_path / "run"))
    so_far: list = []
    for n, rows in enumerate(batches):
        so_far += rows
        touched = {r[0] for r in rows}
        want = {tuple(r) for r in triage(spark.createDataFrame([r for r in so_far if r[0] in touched], schema)).collect()}
        assert {tuple(r) for r in got.where(f"_batch = {n}").drop("_batch").collect()} == want


def test_triage_state_doesnt_grow_with_repeats(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa

    from duoply.streaming import states

    kinds = "game_id long, method string, ply long, san string, similarity double, status string"
    rows = [(1, m, p, s, x, t) for m in ("beam", "greedy") for p in (3, 4) for s, x, t in (("Nf3+", 80.0, "SOLVED"), ("Nf3++", 0.7, "VALID"), (None, None, None))]

    class List:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def put(self, rows):
            self.rows = rows

    p = states.Reports(kinds)
    p.rows = List()
    batch = lambda rs: pa.Table.from_batches(list(states.first_condensed([pa.RecordBatch.from_pandas(pd.DataFrame(rs, columns=states.CONDENSED.names), states.CONDENSED, preserve_index=False)]))).to_pandas()
    for n in range(3):
        [out] = p.handleInputRows((1,), iter([batch(rows * 50), batch(rows)]), None)
        assert len(p.rows.rows) == 4 and len(out) == 4
    assert {tuple(r) for r in triage(spark.createDataFrame(out, kinds)).collect()} == {tuple(r) for r in triage(spark.createDataFrame(rows, kinds)).collect()}
