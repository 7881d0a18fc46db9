"""Operator 12: against plain dictionaries, and its DuckDB text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from duoply.llm import queries, resample

RNG = random.Random(2)
BITS = [" ", "a", "B", "é", "Straße", " and", "x" * 20, "\n", "-", "12", "中文", "z" * 45, "\x00", "ÀÉ", "_"]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def texts(n):
    return ["".join(RNG.choice(BITS) for _ in range(RNG.randint(0, 80))) for _ in range(n)] + [None, "", " ", "A", "a" * 90]


def plain(docs, target, percent=25, least=20, buckets=10_000):
    """rows (doc_id, text) -> rows of the contract, null ids and equal rows in any order."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(x)) for side in ([x for _, x in docs], target))
    every, aim = sum(s.values()), sum(t.values())
    out = []
    for doc, x in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in map(bucket, grams(x))]
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("size", [1 << 20, 30])
def test_features(monkeypatch, size):
    monkeypatch.setattr(resample, "SLICE", size)
    some = texts(150)
    found, single = [Counter() for _ in some], [0] * len(some)
    for who, one, slot, table in resample.features(some, 10_000):
        for k, b, o in zip(who.tolist(), table.bucket[slot].tolist(), one.tolist()):
            found[k][b] += 1
            single[k] += o
    assert found == [Counter(zlib.crc32(g.encode()) % 10_000 for g in grams(x)) for x in some]
    assert single == [len(words(x)) for x in some]


def test_keys_are_xxh64_and_collisions_move_on():
    data = np.frombuffer(bytes(RNG.randrange(256) for _ in range(4000)), dtype=np.uint8)
    start, size = (np.array([RNG.randrange(lo, hi) for _ in range(400)]) for lo, hi in ((0, 3900), (0, 60)))
    spans = resample.Spans(data, start, size)
    assert spans.keys().tolist() == [xxhash.xxh64_intdigest(spans.bytes(i)) for i in range(400)]
    data = np.frombuffer(b"ab" * 100 + b"c" * 100, dtype=np.uint8)
    start, size = np.arange(200), np.arange(200) % 50
    spans = resample.Spans(data, start, size)
    for key in (None, np.zeros(200, dtype=np.uint64), np.full(200, (1 << 64) - 1, dtype=np.uint64)):  # all keys the same: bytes decide
        table = resample.Table(spans, 97, key)
        owner = {}
        for i, slot in enumerate(table.slot.tolist()):
            assert owner.setdefault(slot, spans.bytes(i)) == spans.bytes(i)
        assert len(owner) == len({spans.bytes(i) for i in range(200)}) and table.count.sum() == 200


def test_resample(spark, documents, no_documents):
    many = spark.createDataFrame([(k, x) for k, x in enumerate(texts(300), 100)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(many).repartition(4)
    target = spark.createDataFrame([("a b Straße and",), (None,), ("12 " * 40,)], "text string")
    got = resample.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, got.collect())) == plain(rows, ["a b Straße and", None, "12 " * 40])
    assert resample.resample(documents, target.limit(0)).count() == documents.count()
    assert resample.resample(no_documents, target).count() == 0


def test_oracle(spark, tmp_path):
    docs = [(k, x) for k, x in enumerate(texts(120))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b Straße and"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = Counter(duck.execute(queries.ORACLES["op12_importance_resampling"]).fetchall())
    assert want == Counter(map(tuple, queries.op12_importance_resampling(spark, str(tmp_path)).collect())) == plain(docs, ["a b Straße and", None])
