"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Documents are dealt to blocks of bounded size. A block sends its distinct
n-grams with their counts to the partitions of the count tables (sorted hashes,
packed as differences); a partition sums them over all blocks and answers each
block; the block joins the answers to its exploded n-grams and sums the scores
of each document. An n-gram is one entry a block, however frequent it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoply.llm.common import by_batch
from duoply.llm.textblock import follow, words

WORD = r"[^\x20\x09-\x0D]+"


def exploded(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text of each word, hashes of the 1- to `order`-grams that end at each word; 0 where the text has too few words before it)."""
    parts = list(words(texts))
    text = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    h = [np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)]
    since = np.arange(len(text)) - np.searchsorted(text, text)
    for k in range(1, order):
        longer = follow(np.concatenate([[np.uint64(0)], h[-1][:-1]]), h[0])
        h.append(np.where(since >= k, longer, np.uint64(0)))
    return text, h


def packed(values: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane, compressed: planes of zeros vanish."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, block_bytes: int = 10 << 20, least_blocks: int = 24) -> DataFrame:
    """(doc_id, n_words, log_score, score, n_unseen) of every whole text.

    Words are runs of non-blanks, lower-cased. Counts are those of all other
    documents (a document's own occurrences are taken off), so a text isn't
    known by itself. S(w | h) = c(hw) / c(h) if c(hw) > 0, else backoff * S of
    the shorter history; a single word has max(c(w), 0.5) / N. log_score sums
    the logarithms, score is their mean, n_unseen counts words that no other
    document has. Null, empty and blank texts have 0 words and score 0.
    Repeated rows are documents of their own. Blocks are dealt by a hash of the
    row and its place in the input, so rows of one doc_id, or without one,
    spread over all of them. Words and n-grams are known by 64-bit hashes: of
    10**9 different n-grams about one pair in 40 such corpora is taken for one.
    A text longer than a block is a block of its own; it is cut into slices only
    while words are hashed.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).first()
    total = size.words or 0
    blocks = max(least_blocks, -(-(size.bytes or 0) // block_bytes))
    shards = 1 << max(5, int(blocks - 1).bit_length())
    shift = np.uint64(64 - (shards.bit_length() - 1))
    kind = dict(docs.dtypes)["doc_id"]
    plain = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))

    def pressed(batch):  # the texts move once, compressed
        press = zstandard.ZstdCompressor(level=3).compress
        return {"doc_id": batch.column(0), "text": [press((x or "").encode()) for x in batch.column(1).to_pylist()], "block": batch.column(2)}

    def texts(t) -> list[str]:
        open_ = zstandard.ZstdDecompressor().decompress
        return [open_(x).decode() for x in t["text"].to_pylist()]

    dealt = by_batch(plain, pressed, f"doc_id {kind}, text binary, block int")

    def send(key, t):
        _, grams = exploded(texts(t), order)
        out = {k: [] for k in ("block", "gram", "shard", "keys", "counts")}
        for k, h in enumerate(grams):
            names, n = np.unique(h[h != 0], return_counts=True)
            shard, first = np.unique((names >> shift).astype(np.int64), return_index=True)
            for s, a, b in zip(shard.tolist(), first.tolist(), [*first[1:].tolist(), len(names)]):
                for column, v in zip(out, (key[0].as_py(), k, s, packed(np.diff(names[a:b], prepend=np.uint64(0))), packed(n[a:b].astype(np.int64)))):
                    out[column].append(v)
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("gram", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(t):
        keys = [np.cumsum(unpacked(b, np.uint64)) for b in t["keys"].to_pylist()]
        counts = np.concatenate([unpacked(b) for b in t["counts"].to_pylist()])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=counts).astype(np.int64)[back]
        return pa.table({"block": t["block"], "gram": t["gram"], "shard": t["shard"], "sums": [packed(x) for x in np.split(sums, np.cumsum([len(k) for k in keys])[:-1])]})

    def join(key, own, answers):
        text, grams = exploded(texts(own), order)
        n_docs = own.num_rows
        blobs = sorted(zip(answers["gram"].to_pylist(), answers["shard"].to_pylist(), answers["sums"].to_pylist()))
        counts = []
        for k, h in enumerate(grams):  # what other documents have of each n-gram, at each word
            here = np.flatnonzero(h != 0)
            _, back = np.unique(h[here], return_inverse=True)
            sums = np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(b) for g, _, b in blobs if g == k)])
            _, pair, own_n = np.unique(back * n_docs + text[here], return_inverse=True, return_counts=True)
            c = np.zeros(len(h), dtype=np.int64)
            c[here] = sums[back] - own_n[pair]
            counts.append(c)
        n_words = np.bincount(text, minlength=n_docs)
        rest = np.maximum(total - n_words[text], 1)
        p = np.log(np.maximum(counts[0], 0.5) / rest)
        for k in range(1, order):
            before = np.concatenate([[1], counts[k - 1][:-1]])
            seen = counts[k] > 0
            p = np.where(seen, np.log(np.where(seen, counts[k], 1) / np.where(seen, before, 1)), np.where(grams[k] != 0, np.log(backoff), 0.0) + p)
        sums = np.bincount(text, weights=p, minlength=n_docs)
        return pa.table({"doc_id": own["doc_id"], "n_words": n_words, "log_score": sums, "score": sums / np.maximum(n_words, 1), "n_unseen": np.bincount(text, weights=counts[0] <= 0, minlength=n_docs).astype(np.int64)})

    asked = dealt.groupBy("block").applyInArrow(send, "block int, gram int, shard int, keys binary, counts binary")
    answers = asked.groupBy("gram", "shard").applyInArrow(answer, "block int, gram int, shard int, sums binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, f"doc_id {kind}, n_words long, log_score double, score double, n_unseen long")
