"""corpus_pipeline: stages against what they promise, and run() against the stages."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duoply.llm import langid, mixing, simhash
from duoply.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    assert after.count() >= 0.98 * before.count()
    before, after = seen["simhash_dedup"]
    groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert {r.doc_id for r in after.collect()} == groups
    before, after = seen["source_mix"]
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 3


def test_run_against_brute_force(spark, documents, tmp_path):
    """Each stage by plain loops over what the stage before it kept; the mix, whose rounding is free, by its promises."""
    own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    docs = own.unionByName(documents.select(own.columns).withColumn("doc_id", F.col("doc_id") + 1000).withColumn("n_chars", F.length("text").cast(dict(own.dtypes)["n_chars"])))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bag = lambda rows: Counter((r.doc_id, r.text or "", r.lang, r.source) for r in rows)

    model = langid.fit(langid.learnable(docs))
    rows = docs.collect()
    rows = [r for r, stays in zip(rows, model.known([r.text for r in rows])) if stays]
    after = P.identify_language(spark, docs, SF)
    assert bag(after.collect()) == bag(rows)

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 10 and r.doc_id is not None:
                holders.setdefault(key(x), set()).add(r.doc_id)
    kept = lambda r, x: r.doc_id is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == r.doc_id
    want = Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if kept(r, x)), r.lang, r.source) for r in rows)
    after = P.dedup_lines(spark, after, SF)
    assert bag(after.collect()) == want

    rows = after.collect()
    prints = [simhash.fingerprint_of(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    after = P.dedup_documents(spark, after, SF)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == Counter(best.values())

    before, after = after, P.mix_sources(spark, after, SF)
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("n")).collect()}
    have, got = words(before), words(after)
    names = sorted(have, key=lambda s: (s is None, (s or "").encode()))
    longest = max(len((r.text or "").split()) for r in before.collect())
    for name, target in zip(names, mixing.shares([have[n] for n in names], 3)):
        assert abs(got.get(name, 0) - target) <= longest
    copies, single = bag(after.collect()), bag(before.collect())
    assert all(n <= 3 * single[k] for k, n in copies.items())

    packed = P.pack_sequences(spark, after, SF)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in after.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        cut = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want.update((r.doc_id, k, a, b - a) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    packed = packed.collect()
    assert Counter(tuple(r)[:4] for r in packed) == want
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert Counter(tuple(r)[:4] for r in P.run(spark, str(tmp_path)).collect()) == want


def test_awkward_rows(spark, documents, no_documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    empty = no_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_language_stage_drops_texts_of_no_language_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Ελληνικό κείμενο για δοκιμή", "这是一个中文句子", "Это русский текст для проверки", "日本語のテキストです", "عربي نص", "xkcd qzw vbrt kjhg zxcv", "QkFTRTY0IGVuY29kZWQgZGF0YSBsb29rcyBsaWtl", "12 !!", "", None]
    extra = spark.createDataFrame([(-1 - k, x, None, "x", 1) for k, x in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.identify_language(spark, docs.unionByName(extra.select(docs.columns)), SF).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    clean = {r.doc_id for r in docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(clean) > 200 and clean <= kept


def test_language_stage_without_labels_keeps_texts_with_a_letter(spark, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert lettered == 9
    assert P.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == lettered
    assert P.identify_language(spark, docs, SF).count() == lettered


def test_simhash_stage_keeps_a_row_of_each_group(spark, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    unique, other = "nothing else here has these few words", "another text under an id that was given before"
    odd = [(1, unique), (None, unique), (7, other), (7, other), (None, "no id and no copy"), (None, "no id and no copy"), (None, "Plain words of one document\nthis line stands in several documents"), (20, None), (None, " ")]
    docs = docs.unionByName(spark.createDataFrame([(i, x, "en", "a", 1) for i, x in odd], docs.schema))
    got = Counter((r.doc_id, (r.text or "")[:20]) for r in P.dedup_documents(spark, docs, SF).collect())
    text = {r.doc_id: (r.text or "")[:20] for r in documents.where("doc_id is not null").collect()}
    want = [(i, text[i]) for i in (1, 2, 5, 7, 8, 10, 12)] + [(1, unique[:20]), (7, other[:20]), (None, "no id and no copy"), (None, "this line stands in ")]
    assert got == Counter(want)


def test_columns_of_any_name_come_through(spark, documents):
    """Stages pick temporary names that the input doesn't have."""
    names = ["_size", "_place", "_copies", "_copy", "_x", "_y", "_keep_x", "_doc", "_lines", "_keeper", "_n", "_plan_size", "_0", "_1", "_2", "_block", "size", "n_rows", "fp", "row", "line", "key"]
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents.select(own).withColumn("n_chars", F.length("text").cast("long"))
    more = docs.withColumns({n: F.concat_ws("|", F.lit(n), F.col("doc_id").cast("string"), F.col("source")) for n in names})
    few, many = docs, more
    for name, stage in P.STAGES[:-1]:
        few, many = stage(spark, few, SF), stage(spark, many, SF)
        assert many.columns == more.columns
        rows = many.collect()
        assert len(rows) == few.count() or name in ("simhash_dedup", "source_mix")
        for r in rows:
            assert all(r[n] == "|".join([n, *(str(v) for v in (r.doc_id, r.source) if v is not None)]) for n in names)
        assert sorted({(r.doc_id or 0, r.text or "") for r in rows}) == sorted({(r.doc_id or 0, r.text or "") for r in few.collect()}) or name == "source_mix"
