"""Language ID, toxicity, backoff scores and vector search: brute force, held-out accuracy, awkward rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duoply.llm import ann, backoff, langid, textblock, topk, toxicity
from duoply.llm.common import sampled

SF = "/root/testdata/sf0.01"


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.fit(langid.learnable(docs))).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_id_of_awkward_rows(documents, no_documents):
    model = langid.fit(documents)
    got = langid.identify(documents, model).toPandas()
    assert len(got) == documents.count() and set(got.lang_pred) <= {"de", "en", "und"}
    by_id = got.dropna().set_index("doc_id").lang_pred
    assert all(by_id[i] == "und" for i in (2, 3, 4, 8)) and by_id[12] != "und"
    assert langid.identify(no_documents, model).count() == 0
    assert set(langid.identify(documents, langid.fit(no_documents)).toPandas().lang_pred) == {"und"}


def test_ngrams_of_a_split_text_are_those_of_the_whole(monkeypatch):
    text = "Ein längerer Text, zerlegt in Stücke " * 30
    count = lambda: Counter(np.concatenate([s.ravel() for _, s in langid.grams([text, None, "", "x"])]).tolist())
    whole = count()
    monkeypatch.setattr(langid, "SLICE", 50)
    assert count() == whole


def test_ftrl_leaves_most_weights_at_zero(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert (langid.fit(langid.learnable(docs)).table == 0).mean() > 0.5


def test_toxicity_of_planted_words(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abdegiklmnorstu"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        text = list(rng.choice(words, 60))
        if bad := i % 4 == 0:
            text[10] = "vexqu" + "".join(rng.choice(list("aeiou"), 3))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and (got.predicted == got.toxic).mean() > 0.97


def test_toxicity_of_awkward_rows(spark, documents, no_documents):
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, None), (7, 0, 1), (6, 0, 1), (6, 0, 0), (None, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(documents, toxicity.fit(documents, marks)).toPandas()
    assert len(got) == documents.count() and got.score.between(0, 1).all() and got.score.notna().all()
    untaught = toxicity.fit(no_documents, marks.limit(0))
    assert toxicity.score(no_documents, untaught).count() == 0 and toxicity.score(documents, untaught).count() == documents.count()


def slow_kneser_ney(counts, discount=0.75):
    """P(symbol | four symbols, class) from dictionaries; counts: five symbols -> occurrences in each class."""
    kinds = [set() for _ in range(6)]
    kinds[5] = set(counts)
    for j in range(4, 0, -1):
        kinds[j] = {g[1:] for g in kinds[j + 1]}
    fronts = [Counter() for _ in range(5)]
    for j in range(1, 5):
        fronts[j].update(g[1:] for g in kinds[j + 1])
    after = [defaultdict(list) for _ in range(5)]
    for j in range(1, 5):
        for g, n in fronts[j].items():
            after[j][g[:-1]].append(n)

    def shared(g):
        if not g:
            return 1 / 32
        below, some = shared(g[1:]), after[len(g)].get(g[:-1])
        return below if not some else (max(fronts[len(g)][g] - discount, 0) + discount * len(some) * below) / sum(some)

    follow = defaultdict(list)
    for g in counts:
        follow[g[:-1]].append(g)

    def p(g, c):
        n = [counts[x][c] for x in follow[g[:-1]]]
        if not sum(n):
            return shared(g[1:])
        return (max(counts.get(g, (0, 0))[c] - discount, 0) + discount * sum(x > 0 for x in n) * shared(g[1:])) / sum(n)

    return p


def test_kneser_ney_is_that_of_dictionaries_and_sums_to_one():
    rng = np.random.default_rng(2)
    grams = {tuple(int(x) for x in rng.integers(0, 6, 5)) for _ in range(900)}
    counts = {g: tuple(int(x) for x in n) for g, n in zip(sorted(grams), rng.integers(0, 4, (len(grams), 2))) if n.sum()}
    code = lambda g: sum(x << (5 * (len(g) - 1 - i)) for i, x in enumerate(g))
    order = sorted(counts, key=code)
    gain, context, rest = toxicity.kneser_ney(np.array([code(g) for g in order]), np.array([counts[g] for g in order]))
    p = slow_kneser_ney(counts)
    assert np.allclose(gain, [math.log(p(g, 1) / p(g, 0)) for g in order])
    for g in order[:40]:
        assert sum(p((*g[:-1], s), 0) for s in range(32)) == pytest.approx(1) and sum(p((*g[:-1], s), 1) for s in range(32)) == pytest.approx(1)
        unseen = next(s for s in range(32) if (*g[:-1], s) not in counts)
        assert rest[np.searchsorted(context, code(g[:-1]))] == pytest.approx(math.log(p((*g[:-1], unseen), 1) / p((*g[:-1], unseen), 0)))


def test_toxicity_of_a_split_text_is_that_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(1, 1 << 25, 4000))
    model = toxicity.Model(key, rng.normal(size=len(key)), np.unique(key >> 5), rng.normal(size=len(np.unique(key >> 5))), None)
    model._table = rng.normal(size=1 << 25).astype(np.float16)
    texts = ["Einige Wörter, zerlegt in Stücke; " * 9, "a" * 333, "", None, "x y " * 40, "kurz", "abc" * 50 + " " + "d" * 60]
    whole = model.features(texts)
    monkeypatch.setattr(toxicity, "SLICE", 50)
    assert np.allclose(model.features(texts), whole)


def test_ftrl_steps_are_those_of_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), np.sort(rng.choice(200, 12, replace=False)), rng.random(12)) for _ in range(60)]
    z, n, alpha, beta, l1, l2 = defaultdict(float), defaultdict(float), 0.3, 1.0, 0.02, 0.02

    def weight(i, c):
        v = z[i, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(60):
            y, slots, values = rows[k]
            x = [*zip(slots.tolist(), values.tolist()), (1 << langid.BITS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            e = [math.exp(sum(v * w[i, c] for i, v in x)) for c in range(3)]
            for i, v in x:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * w[i, c]
                    n[i, c] += g * g
    got = langid.ftrl(rows, 3)
    assert all(got[i, c] == pytest.approx(weight(i, c)) for i in [*range(200), 1 << langid.BITS] for c in range(3))


def slot(*letters):
    """Slot of an n-gram, last letter first."""
    h = sum(ord(x) * m for x, m in zip(letters, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) + len(letters)
    h &= 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    return (h ^ (h >> 12)) >> (32 - langid.BITS)


def test_probabilities_are_those_of_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    texts = [r.text for r in docs.where("length(text) < 600").limit(40).collect()] + ["Ein kurzer Satz", "no", "Straße 12"]
    found, score = model.predict(texts)
    for text, label, p in zip(texts, found, score):
        x, total, n = f"\0\0{text.lower()}", np.zeros(len(model.labels)), 0
        for i in range(2, len(x)):
            if x[i].isalpha():
                a, b = (x[i - k] if x[i - k].isalpha() else "\0" for k in (1, 2))
                total += sum(model.table[s].astype(float) for s in (slot(x[i]), slot(x[i], a), slot(x[i], a, b)))
                n += 1
        if not n:
            assert label == "und" and p == 0
            continue
        e = np.exp((total / (3 * n) * langid.SCALE + model.bias) / model.heat)
        assert label == model.labels[int(np.argmax(e))] and p == pytest.approx(float(np.max(e) / e.sum()), abs=1e-4)
    assert math.exp(-4.9) < model.heat < math.exp(4.9)


def brute_backoff(rows, order=3, backoff_=0.4):
    split = [(d, (t or "").lower().encode().split()) for d, t in rows]
    grams = lambda w, k: Counter(tuple(w[i - k + 1 : i + 1]) for i in range(k - 1, len(w)))
    total = [sum((grams(w, k) for _, w in split), Counter()) for k in range(1, order + 1)]
    n = sum(len(w) for _, w in split)
    out = []
    for d, w in split:
        own = [grams(w, k) for k in range(1, order + 1)]
        rest, s, unseen = max(1, n - len(w)), 0.0, 0
        for i in range(len(w)):
            c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
            weight = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    s += math.log(weight * max(c(g), 0.5) / rest)
                    unseen += c(g) <= 0
                elif c(g) > 0:
                    s += math.log(weight * c(g) / c(g[:-1]))
                    break
                else:
                    weight *= backoff_
        out.append((d, len(w), round(s, 6), unseen))
    return Counter(out)


def test_stupid_backoff(spark, documents, no_documents, monkeypatch):
    docs = documents.select("doc_id", "text", "block", "key").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1), F.lit(2)).where("doc_id >= 100"))
    got = backoff.score(docs, block_bytes=100_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6), r.n_unseen) for r in got.collect()) == brute_backoff(rows)
    assert backoff.score(no_documents).count() == 0
    whole = backoff.exploded([r.text for r in documents.collect()], 3)
    monkeypatch.setattr(textblock, "SLICE", 50)
    cut = backoff.exploded([r.text for r in documents.collect()], 3)
    assert (cut[0] == whole[0]).all() and all((a == b).all() for a, b in zip(cut[1], whole[1]))


def test_sample_is_bounded_by_rows_and_labels(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").when(F.col("id") < 2900, "b").otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("label"))
    got = Counter(r.label for r in sampled(df, "label", 300, labels=2).collect())
    assert set(got) == {"a", "b"} and all(200 < n < 400 for n in got.values())
    assert sampled(df, "label", 10**6).count() == 2900 + 100 and sampled(df.limit(0), "label", 5).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, part int, vector string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(900)]
    rows += [(i, rows[i % 5][1]) for i in range(900, 1300)]  # many copies of five vectors
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] + [1.0] * 7), (2200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2300, []), (50, rows[50][1])]
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)


def usable(vectors, zero):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    return {i: v for i, v in rows.items() if zero or v.any()}


def test_bit_sliced_top_k(vectors):
    rows = {i: np.floor(256 * v).astype(int) for i, v in usable(vectors, True).items()}
    want = set()
    for q in (i for i in rows if i % 50 == 0):
        best = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(vectors, rows=100, queries=8).collect()} == want
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_large_components_stay_exact_or_are_refused(spark):
    big = [(0, [1e13, -3e12]), (50, [3e12, 1e13]), (1, [2e13, 1.0]), (2, [-1e13, 5e12]), (3, [1.0, 1.0])]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in big], "vec_id long, embedding array<double>")
    small = df.select("vec_id", F.transform("embedding", lambda v: v / 1e5).alias("embedding"))
    for some, scale in ((small, 1e5), (df.where("vec_id in (0, 3)"), 1.0)):
        rows = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in some.collect()}
        want = {(q, i): sum(a * b for a, b in zip(rows[q], v)) for q in rows if q % 50 == 0 for i, v in rows.items() if i != q}
        assert {(r.query_id, r.vec_id): r.score for r in topk.top_k(some).collect()} == want
    with pytest.raises(Exception):  # a score beyond 64 bits
        topk.top_k(df).collect()
    with pytest.raises(Exception, match="2\\*\\*62"):
        topk.top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_bitmap_sums_are_inner_products():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-300, 300, (130, 5)), rng.integers(-300, 300, (7, 5))
    maps, low = topk.slices(x)
    total = topk.sums(maps, q)
    got = sum(np.unpackbits(t.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(int) << p for p, t in enumerate(total))
    top = (1 << maps.shape[1]) - 1
    constant = (low * q).sum(axis=1) - np.where(q < 0, -q, 0).sum(axis=1) * top
    assert (got + constant[:, None] == q @ x.T).all()


def exact(rows, k, every):
    out = []
    for q in (i for i in rows if i % every == 0):
        best = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return out


def test_search_of_few_rows(vectors):
    """Fewer rows than two parts need are one part, searched exactly."""
    few = vectors.where("vec_id < 60 or vec_id >= 2000 or vec_id is null")
    want = exact(usable(few, False), 10, 100)
    got = sorted(map(tuple, ann.search(few, rows=100, queries=3).collect()))
    assert [g[:3] for g in got] == sorted(w[:3] for w in want) and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    assert ann.search(vectors.limit(0)).count() == 0 and ann.search(vectors.where("vec_id < 4")).count() == 3


def test_parts_at_every_size_and_all_neighbours(spark, vectors):
    """The tables have several parts from the smallest size on; recall is taken over all queries, and each gets its ten."""
    for df in (vectors, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")):
        rows = usable(df, False)
        index = ann.fit(spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, vector array<double>"), len(rows), 10)
        assert index.parts >= 8 and index.router is not None
        got, want = ann.search(df, rows=100, queries=3).collect(), exact(rows, 10, 100)
        assert Counter(r.query_id for r in got) == {q: 10 for q in rows if q % 100 == 0}
        assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_a_query_visits_parts_until_there_are_enough_rows():
    rng = np.random.default_rng(0)
    index = ann.Index(rng.normal(size=(400, 4)), 8, 10, 0.1)
    x, held = rng.normal(size=(50, 4)), np.full(index.parts, 3)
    assert index.parts == 8 and all(len(v) >= 4 for v in index.visited(x, held, 10)) and all(len(v) == 8 for v in index.visited(x, held, 99))


def test_learned_partitions_find_most_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = ann.search(df, sample=3000, part_rows=300)
    want = spark.createDataFrame(exact({i: v.astype(float) for i, v in enumerate(x)}, 10, 100), "query_id long, rank int, vec_id long, score double")
    assert ann.recall(got, want) >= 0.9
    index = ann.Index(x[:3000].astype(float), 12, 10, 0.97)
    assert index.parts == 12 and index.visits < 12


def test_sample_of_rows_without_or_with_one_id(spark):
    """Null ids, one id for all, and equal rows: every label keeps about its share."""
    rows = [(i, x, label) for i in (None, 7) for label, n in (("a", 6000), ("b", 400)) for x in ([f"text {k}" for k in range(n // 2)] + ["the same"] * (n // 2))]
    for doc_id in (None, 7):
        df = spark.createDataFrame([(i, x, y, 1, "z") for i, x, y in rows if i == doc_id], "doc_id long, text string, label string, _0 int, _1 string").repartition(4)
        got = Counter(r.label for r in sampled(df, "label", 300).collect())
        assert 220 < got["a"] < 390 and 220 < got["b"] < 390 and sampled(df, "label", 300).columns == df.columns
        assert sampled(df, "label", 10**6).count() == df.count()


def test_languages_are_learned_without_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')").withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.fit(langid.learnable(docs), most=200).labels == ["de", "en"]
