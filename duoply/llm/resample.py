"""Importance resampling towards a target corpus, by hashed word n-grams.

The texts of a batch are turned into one buffer of lower-cased words joined by
single spaces, so that a word, or two consecutive words, are a span of it. An
open-addressed table interns the spans: XXH64 of a span chooses the slot, the
span's bytes are compared with those of the slot's first span, and a collision
moves on to the next slot. Each distinct n-gram's bucket is found once a batch,
and all else (counts a bucket, gains of occurrences) is gathered by slot.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoply.llm.common import by_batch, saved, strides
from duoply.operators.order import ordinals

#: Bytes of words that are interned together; a single longer word is taken as a whole.
SLICE = 1 << 20
#: Spans up to so many bytes are hashed side by side, longer ones one by one.
WIDE = 31
#: Bytes of words: digits, lower-case letters and all beyond ASCII (fixed values).
WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Multipliers of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()


class Spans:
    """Spans data[start : start + size] with what hashing and comparing them needs: up to WIDE bytes each in four lanes of eight."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        padded = np.concatenate([data, np.zeros(40, dtype=np.uint8)])
        at = np.lib.stride_tricks.sliding_window_view(padded, 8)
        used = -(-size.clip(0, WIDE) // 8)
        self.lanes = np.zeros((4, len(start)), dtype=np.uint64)
        for lane in range(4):
            who = np.flatnonzero((used > lane) & (size <= WIDE))
            value = np.ascontiguousarray(at[start[who] + 8 * lane]).view("<u8").ravel()
            rest = (8 * (size[who] - 8 * lane)).clip(0, 64)
            keep = np.where(rest >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest % 64).astype(np.uint64)) - np.uint64(1))
            self.lanes[lane, who] = value & keep

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def keys(self) -> np.ndarray:
        """XXH64 with seed 0 of each span."""
        size = self.size.astype(np.uint64)
        h = P5 + size
        for lane in range(3):
            whole = np.flatnonzero((self.size >= 8 * (lane + 1)) & (self.size <= WIDE))
            h[whole] = _turn(h[whole] ^ (_turn(self.lanes[lane, whole] * P2, 31) * P1), 27) * P1 + P4
        rest = self.lanes[(self.size // 8).clip(0, 3), np.arange(len(size))]
        left = self.size % 8
        four = np.flatnonzero((left >= 4) & (self.size <= WIDE))
        h[four] = _turn(h[four] ^ ((rest[four] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        rest[four] >>= np.uint64(32)
        left = left % 4
        for byte in range(3):
            who = np.flatnonzero(left > byte)
            h[who] = _turn(h[who] ^ ((rest[who] >> np.uint64(8 * byte) & np.uint64(255)) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(self.size > WIDE).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes(i))
        return h

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether spans i and j have the same bytes."""
        equal = self.size[i] == self.size[j]
        for lane in self.lanes:
            equal &= lane[i] == lane[j]
        for k in np.flatnonzero(equal & (self.size[i] > WIDE)).tolist():
            equal[k] = self.bytes(i[k]) == self.bytes(j[k])
        return equal

    def buckets(self, which: np.ndarray, buckets: int) -> np.ndarray:
        """crc32 modulo buckets of some spans."""
        size = self.size[which]
        crc = np.full(len(which), 0xFFFFFFFF, dtype=np.uint32)
        for t in range(int(size[size <= WIDE].max(initial=0))):
            who = np.flatnonzero((size > t) & (size <= WIDE))
            byte = (self.lanes[t // 8, which[who]] >> np.uint64(8 * (t % 8)) & np.uint64(255)).astype(np.uint32)
            crc[who] = CRC[(crc[who] ^ byte) & np.uint32(255)] ^ (crc[who] >> np.uint32(8))
        crc = ~crc
        for k in np.flatnonzero(size > WIDE).tolist():
            crc[k] = zlib.crc32(self.bytes(which[k]))
        return (crc % np.uint32(buckets)).astype(np.int64)


class Table:
    """An open-addressed table of the spans of one batch: slots hold the first span of each n-gram, its count and its bucket."""

    def __init__(self, spans: Spans, buckets: int, key: np.ndarray | None = None):
        n = len(spans.start)
        room = 1 << max(4, (2 * n).bit_length())
        self.key, self.first = np.zeros(room, dtype=np.uint64), np.full(room, -1, dtype=np.int64)
        key = spans.keys() if key is None else key
        self.slot = (key & np.uint64(room - 1)).astype(np.int64)
        wait = np.arange(n)
        while len(wait):
            at = self.slot[wait]
            empty = self.first[at] < 0
            self.first[at[empty][::-1]] = wait[empty][::-1]  # of spans that want one slot the first gets it
            self.key[at[empty]] = key[self.first[at[empty]]]
            held = self.first[at]
            mine = self.key[at] == key[wait]
            mine[mine] = spans.same(held[mine], wait[mine])
            wait = wait[~mine]
            self.slot[wait] = (self.slot[wait] + 1) & (room - 1)
        self.count = np.bincount(self.slot, minlength=room)
        used = np.flatnonzero(self.first >= 0)
        self.bucket = np.zeros(room, dtype=np.int64)
        self.bucket[used] = spans.buckets(self.first[used], buckets)


def _word_slices(text: str | None) -> Iterator[bytes]:
    """The lower-cased bytes of a text in slices that end between words."""
    data, at = (text or "").encode().lower(), 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE:
            gap = np.flatnonzero(~WORD[np.frombuffer(data, dtype=np.uint8, count=SLICE, offset=at)])
            end = at + int(gap[-1]) + 1 if len(gap) else next((i + 1 for i in range(at + SLICE, end) if not WORD[data[i]]), end)
        yield data[at:end]
        at = end


def _words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer of all words, each followed by one space; start, size and slice of each word)."""
    data = np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)
    inside = WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[0::2], edge[1::2]
    part = np.searchsorted(np.cumsum([len(b) + 1 for b in held]), begin, side="right")
    keep = inside.copy()
    keep[end] = True
    packed = np.where(inside, data, np.uint8(32))[keep]
    size = end - begin
    return packed, np.cumsum(size + 1) - size - 1, size, part


def features(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of one and two words of whole texts, slice by slice: (text of each occurrence, whether it is a single word, its slot, the slots' table). Two words may be of neighbouring slices."""
    held: list[bytes] = []
    owner: list[int] = []
    size, before = 0, b""

    def interned():
        data, start, n, part = _words(held)
        text = np.array(owner)[part]
        again = np.array(carried)[part] & (np.diff(part, prepend=-1) > 0)  # words that an earlier slice has counted
        pair = np.flatnonzero((text[1:] == text[:-1]) & ((part[1:] == part[:-1]) | ~np.array(carried)[part[1:]]))
        first = np.concatenate([np.flatnonzero(~again), pair])
        end = start + n
        length = np.concatenate([n[~again], end[pair + 1] - start[pair]])
        single = np.arange(len(first)) < len(first) - len(pair)
        table = Table(Spans(data, start[first], length), buckets)
        return text[first], single, table.slot, table

    carried: list[bool] = []
    for k, x in enumerate(texts):
        before = b""
        for piece in _word_slices(x):
            if held and size + len(piece) > SLICE:
                yield interned()
                held, owner, carried, size = [], [], [], 0
            # the last word of the slice before leads, where that slice isn't in the same table
            lead = bool(before)
            held.append(before + b" " + piece if lead else piece)
            owner.append(k)
            carried.append(lead)
            size += len(held[-1]) + 1
            words = np.flatnonzero(np.diff(WORD[np.frombuffer(piece, dtype=np.uint8)], prepend=False, append=False))
            if len(words):
                before = piece[words[-2] : words[-1]]
    if held:
        yield interned()


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of the n-grams of each bucket in all texts. A task sums up its own and sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for batch in strides(whole):
                for _, _, _, table in features(batch.column(0).to_pylist(), buckets):
                    total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """Gain of each bucket: floor(1000 ln) of its smoothed share in the target over that in docs. The driver gets one number a bucket and side."""
    found = bucket_counts(docs, buckets, text).withColumn("side", F.lit(0)).union(bucket_counts(target, buckets, text).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), dtype=np.int64)
    for r in found.collect():
        counts[r.side, r.bucket] = r.n
    (s, t), (every, aim) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the gains of each whole text's features, 0 if it has none."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batch):
        texts, gain = batch.column(1).to_pylist(), shared.value
        n, words, total = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        for who, single, slot, table in features(texts, len(gain)):
            n += np.bincount(who, minlength=len(texts))
            words += np.bincount(who[single], minlength=len(texts))
            np.add.at(total, who, gain[table.bucket[slot]])
        return {key: batch.column(0), "n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)}

    return by_batch(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_words long, n_features long, weight long")


def noise(key, seed: int):
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 made from sha256 of seed and key: Gumbel noise that reruns repeat. A null key counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = 10_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_features, weight, score, rank) of every document: how likely it is under the target's n-grams against the corpus' own, and its place among the drawn.

    Features are all runs of one and two words of whole texts (a null text has
    none; long texts are read in slices, two words meet across them); weight is
    the floored mean of their buckets' gains, 0 without features. Of the
    documents with at least `least` words, the floor(percent * N / 100) of
    highest score (weight plus noise) are drawn and ranked, ties to the smaller
    key, a null key first; others have a null rank. Repeated rows stay rows;
    other columns aren't read; an empty target or corpus has counts of zero.
    """
    scored = saved(weigh(docs, gains(docs, target, buckets, text), text, key).withColumn("score", F.col("weight") + noise(F.col(key), seed)))
    may = F.col("n_words") >= least
    n = scored.where(may).count()
    taken = ordinals(scored.where(may), [], [F.desc("score"), key, "n_features"], "rank").withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    names = [key, "n_features", "weight", "score", "rank"]
    return taken.select(names).union(scored.where(~may).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
