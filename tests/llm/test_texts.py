"""Tokens, packing, lines, fingerprints, mixing: against brute force, with awkward rows."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duoply.llm import bpe, linededup, mixing, packing, simhash, token_count
from duoply.llm.common import saved, strides, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def compiled():
    return bpe.Transducer(PATH, most_states=4096)


def ids(library, texts):
    return [e.ids for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_transducer_counts_and_ids(library, compiled):
    rng = random.Random(5)
    bits = ["\u1c89a", "\U00016100", "'s", "'re", "'ll", "'ve", "'", " ", "  ", "\n", "\t", "the", " and", "Straße", "12", "!", "é", "<|endoftext|>", "中文", "😀", "x" * 40, " ", "r", "e", "l"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(300)] + [None, "", "a" * 5000, " " * 700, "'l", "a'r"]
    want = ids(library, texts)
    assert compiled.counts(texts).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in compiled.ids(texts)] == want


def test_slices_inside_texts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "LONG", 64)
    rng = random.Random(6)
    bits = ["'s", "'re", "'", " ", " " * 60, "\n", "\t", "the", " and", "Straße", "12", "!", "é", "<|endoftext|>", "中文", "x" * 120, "'" * 70 + "s", "!" * 110, "'ll" * 30, "7" * 90]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(120)] + [None, "", " " * 700, "a" * 900, "'" * 100 + "s" * 100, "é" * 300 + " x"]
    want, own = ids(library, texts), bpe.Transducer(PATH, most_states=256)
    assert own.counts(texts).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in own.ids(texts)] == want


def test_a_long_text_takes_little_memory():
    script = f"import resource; from duoply.llm import bpe; t = bpe.Transducer({PATH!r}); t.counts(['warm up']); x = 'some words of a text, ' * 1_000_000; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = t.counts([x]); print(n[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)"
    n, grown = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout.split())
    assert n > 5_000_000 and grown < 150_000  # kB, beside the 22 MB of the text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t'strevlmd1!éß中a", max_size=400))
def test_chunked_prefix_scan_cuts_like_neighbours(text):
    kinds, size = bpe.classes()[[ord(c) for c in text]], np.array([len(text)])
    assert bpe.cuts(kinds, size).tolist() == bpe.quick_cuts(kinds, size).tolist()


def test_count_tokens(spark, documents, no_documents, library):
    got = token_count.count_tokens(documents, PATH, limit=1024)
    rows = documents.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(i), n > 1024) for r, i in zip(rows, ids(library, [r.text for r in rows])))
    assert Counter(map(tuple, got.collect())) == want
    assert token_count.count_tokens(no_documents, PATH).count() == 0


def test_pack(spark, documents, no_documents, library):
    got = packing.pack(documents, PATH, room=2048).collect()
    rows = documents.select("doc_id", "text").collect()
    texts = defaultdict(list)
    for r, i in zip(rows, ids(library, [r.text for r in rows])):
        texts[r.doc_id].append(np.array([*i, 0], dtype="<u4"))
    want = Counter()
    for doc, many in texts.items():
        for x in many:
            cut = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
            want.update((doc, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter(tuple(r)[:5] for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(no_documents, PATH).count() == 0


def simple_best_fit(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(room - n)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.booleans()), max_size=60), st.integers(1, 5))
def test_swept_ranges_match_like_one_sweep(items, ranges):
    """Pieces, longest first, each take the smallest free gap that holds them; ranges swept alone and joined by rank come to the same sizes."""
    items = sorted(((size, int(piece)) for size, piece in items), key=lambda x: (-x[0], x[1]))
    gaps, want = sorted(size for size, piece in items if not piece), Counter()
    for size, piece in items:
        if piece and (fit := next((g for g in gaps if g >= size), None)):
            gaps.remove(fit)
            want[size, fit] += 1
    got, left, free = Counter(), {}, {}
    for r, part in enumerate(np.array_split(np.arange(len(items)), ranges)):
        size, piece = (np.array([items[i][c] for i in part], dtype=np.int64) for c in (0, 1))
        order, mate = packing.matched(size, piece)
        size, piece = size[order], piece[order]
        got.update((int(size[i]), int(size[m])) for i, m in enumerate(mate) if m >= 0 and piece[i])
        left[r], free[r] = (size[(mate < 0) & (piece == k)].tolist() for k in (1, 0))
        assert not left[r] or not free[r] or left[r][-1] > free[r][0]
    for r, first, last, of, both in packing.spans({r: len(x) for r, x in left.items()}, {r: len(x) for r, x in free.items()}):
        got.update((left[r][k - 1], free[of][both - k - 1]) for k in range(first, last + 1))
    assert got == want


@pytest.mark.parametrize("rows", [40, 100_000])
def test_rounds_come_near_best_fit_decreasing(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    rng = random.Random(9)
    lengths = [rng.choice([2048, rng.randint(900, 2048), rng.randint(200, 800), rng.randint(1, 90)]) for _ in range(400)]
    got = packing.fill(spark.createDataFrame(list(enumerate(lengths)), "id long, length long"), 2048).collect()
    used = defaultdict(int)
    for r in got:
        used[r.seq] += lengths[r.id]
    assert sorted(r.id for r in got) == list(range(400)) and max(used.values()) <= 2048
    assert len(used) <= 1.01 * simple_best_fit(lengths, 2048) + 1


def test_dedup_lines(documents, no_documents):
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(documents, most_bits=1 << 16).collect())
    rows = documents.select("doc_id", "text").collect()
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 10 and r.doc_id is not None:
                holders[key(x)].add(r.doc_id)
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = [x for x in lines if r.doc_id is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r.doc_id]
        want[r.doc_id, "\n".join(keep), len(lines), len(lines) - len(keep)] += 1
    assert got == want
    assert linededup.dedup_lines(no_documents).count() == 0
    assert set(documents.columns) <= set(linededup.dedup_lines(no_documents).columns)


def test_a_full_filter_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_BITS", 1 << 11)
    digest = lambda df: Counter((r.doc_id, hashlib.sha256(r.text.encode()).digest()) for r in df.collect())
    assert digest(linededup.dedup_lines(documents, most_bits=1 << 11)) == digest(linededup.dedup_lines(documents, most_bits=1 << 20))


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_block_by_block(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(n)) + rng.choice(["", " ", "\n"]) for n in range(40)] + [None, "", " \t"]
    whole = [simhash.fingerprint_of(x) for x in texts]
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert [simhash.fingerprint_of(x) for x in texts] == whole and [x % (1 << 64) for x in whole] == [slow_fingerprint(x) for x in texts]


def reach(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_near_duplicates(documents, no_documents):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in documents.collect()}
    want = reach([d for d in prints if d is not None], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {d: p for d, (p, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items() if d is not None} == want
    assert simhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_links_lose_no_pair(spark, heavy):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for x in base[:30]:
        for n in (1, 2, 3, 4):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), heavy).collect()}
    assert got == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def joins(df):
    """Its rows, and the joins of the plan that made them."""
    return df.collect(), re.findall(r"\w+Join \[[^]]*\]", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


def test_balls_are_not_broadcast(spark):
    """Spark takes the exploded balls for as small as the fingerprints."""
    fps = saved(spark.range(0, 2000).select((F.col("id") * 7 - 900).alias("fp")))
    rows, found = joins(simhash.links(fps))
    assert rows and "SortMergeJoin [key, part]" in found and not any(x.startswith("BroadcastHashJoin [key, part]") for x in found)


def test_pieces_are_not_broadcast(spark):
    docs = spark.range(0, 500).select(F.col("id").alias("doc_id"), F.lit("some words of a document").alias("text"))
    rows, found = joins(packing.pack(docs, PATH))
    assert len(rows) == 500 and "SortMergeJoin [_id]" in found


@pytest.mark.parametrize("nodes", [10, 1 << 18])
def test_components_of_a_long_chain(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "NODES", nodes)
    edges = spark.range(0, 300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b")).repartition(7)
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_mix(spark, documents, no_documents):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None, None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "s0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").union(documents.select("doc_id", "text", "lang", "source"))
    plan = mixing.plan_mix(docs, block=100)
    whole = plan.toPandas()
    rows = mixing.each_row(plan, most=7).toPandas()
    assert len(rows) == docs.count() and rows["copies"].between(0, 3).all()
    sums = rows.assign(taken=rows["copies"] * rows["size"]).groupby("source", dropna=False).agg(words=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["words"] == sums["own"]).all() and sums["target"].sum() == pytest.approx(sums["own"].sum())
    assert (abs(sums["taken"] - sums["target"]) <= 0.02 * sums["target"] + 90).loc[[f"s{i}" for i in range(5)]].all()
    again = mixing.plan_mix(docs.repartition(7), block=100).toPandas()
    key = ["source", "doc_id", "size"]
    assert again.sort_values(key)[["copies", "extra"]].values.tolist() == whole.sort_values(key)[["copies", "extra"]].values.tolist()
    least = int((whole["copies"] * whole["n_rows"]).sum())
    assert least <= mixing.mixed(docs, block=100).count() <= least + int((whole["n_rows"] * (whole["extra"] > 0)).sum())
    assert mixing.plan_mix(no_documents).count() == 0 and mixing.mixed(no_documents).columns == no_documents.columns


def test_rates_solve_the_dual(spark):
    """Against bisection for each source alone."""
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(2000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, p in plan.groupby("source", dropna=False):
        size, target, mean = p["size"].to_numpy(), p["target"].iloc[0], p["size"].mean()
        rate = lambda x: 3 / (1 + 2 * np.exp(-x * size / mean))
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (rate(mid) * size).sum() < target else (low, mid)
        full = target >= 3 * size.sum()
        assert np.allclose(p["rate"][size > 0], 3 if full else rate(mid)[size > 0], rtol=1e-6)


def test_repeated_rows_are_rounded_one_by_one(spark):
    rows = [(source, words) for source, words in (("a", 100), ("b", 100), ("c", 100)) for _ in range(2000)]
    docs = spark.createDataFrame([(None, " ".join(["w"] * n), s) for s, n in rows], "doc_id long, text string, source string")
    got = mixing.each_row(mixing.plan_mix(docs)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"))
    assert all(r.n == 2000 and abs(r.taken - r.target) <= 100 for r in got.collect())


def test_shares_stop_at_the_cap():
    got = mixing.shares([100, 10, 1000, 5], 3)
    assert sum(got) == pytest.approx(1115) and got[1] == 30 and got[3] == 15 and all(g <= 3 * s + 1e-9 for g, s in zip(got, [100, 10, 1000, 5]))


def test_strides_bound_what_is_taken_at_once():
    batch = pa.RecordBatch.from_pydict({"n": list(range(50)), "text": ["x" * (10_000 if i % 17 == 3 else 40) if i % 5 else None for i in range(50)]})
    parts = list(strides(batch, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    size = lambda p: sum(len(x or "") for x in p["text"].to_pylist())
    assert all(size(p) <= 1000 + 10_000 and (size(p) <= 1040 or p.num_rows <= 26) for p in parts) and len(parts) > 3
    assert list(strides(batch.slice(0, 0), 1000)) == []
