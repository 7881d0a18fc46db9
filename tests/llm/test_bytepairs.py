"""Operator 11: against the tiktoken library, and back."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from duoply.llm import bpe, bytepairs
from duoply.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
BITS = ["'s", "'re", "'", " ", "  ", "\n", "\t", "the", " and", "Straße", "12", "!", "é", "<|endoftext|>", "中文", "😀", "x" * 40, "Ᲊa", "r", "e", "l", "ther", "\x00"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytepairs.Coder(PATH)


def encoded(coder, texts):
    ids, size = coder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_the_cutter_knows_the_library_s_letters_and_numbers():
    """tiktoken drops what its pattern doesn't match, so a pattern of one class shows that class."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    bytes_only = {bytes([b]): b for b in range(256)}
    for pattern, kinds in ((r"\p{L}", (bpe.STMD, bpe.R, bpe.V, bpe.L, bpe.E, bpe.LETTER)), (r"\p{N}", (bpe.NUMBER,)), (r"\s", (bpe.SPACE, bpe.BLANK))):
        own = np.isin(bpe.classes(), kinds)
        own[0xD800:0xE000] = False
        found = bytes(tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={}).encode_ordinary(every)).decode()
        assert set(map(ord, found)) == set(np.flatnonzero(own).tolist())


def test_ids_are_the_library_s(coder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    texts += ["", "a" * 2000, " " * 700, "ab" * 900, "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(400)), "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(700))]
    assert encoded(coder, texts) == [library.encode_ordinary(x) for x in texts]
    ids, size = coder.encode(texts)
    assert [x.decode() for x in coder.decode(ids, size)] == texts


def test_both_queries_agree_on_every_word(coder, library):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdehilnorstuwé") for _ in range(rng.randint(2, 50))).encode()[: bytepairs.SHORT] for _ in range(600)] + [b"a" * n for n in range(2, 60)] + [b"\xff\xfe", b"e" * 7 + b"r" * 9]
    want = [library.encode_single_token(w) if w in coder.ranks else library._core_bpe.encode_single_piece(w) for w in words]
    want = [w if isinstance(w, list) else [w] for w in want]
    for query in (bytepairs.CONTRACT, bytepairs.CONTRACT_LONG):
        ids, size = coder.contract(words, query)
        got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
        assert [g for g, w in zip(got, words) if w not in coder.ranks] == [x for x, w in zip(want, words) if w not in coder.ranks]


def test_slices_and_forgetting_change_nothing(library, monkeypatch):
    for name, value in (("SLICE", 60), ("TOKENS", 7), ("TOGETHER", 50), ("KNOWN", 20), ("SHORT", 8)):
        monkeypatch.setattr(bytepairs, name, value)
    monkeypatch.setattr(bpe, "SLICE", 50)
    rng, own = random.Random(6), bytepairs.Coder(PATH)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["", " " * 130, "é" * 70 + " x", "'" * 60 + "s"]
    found = [[] for _ in texts]
    for parts, owner in bytepairs.pieces(texts):
        for k, some in zip(owner, encoded(own, parts)):
            found[k] += some
    assert found == [library.encode_ordinary(x) for x in texts]
    assert own.decode(np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found])) == [x.encode() for x in texts]


def test_queries_on_awkward_rows(spark, documents, no_documents, library):
    rows = documents.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bytepairs.round_trip(documents, PATH).collect())) == want
    there = bytepairs.encode(documents, PATH)
    assert Counter((r.doc_id, tuple(r.ids)) for r in there.collect()) == Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in rows)
    assert Counter((r.doc_id, bytes(r.data)) for r in bytepairs.decode(there, PATH).collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in rows)
    assert bytepairs.round_trip(no_documents, PATH).count() == bytepairs.encode(no_documents, PATH).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 0])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.data) for r in bytepairs.decode(lists, PATH).collect()} == {1: b"", 2: b"", 3: b"!!"}
    with pytest.raises(Exception, match="an id has no token"):
        bytepairs.decode(spark.createDataFrame([(1, [50_300])], "doc_id long, ids array<int>"), PATH).collect()
