"""Line dedup with two Bloom filters and an exact check of what they suspect.

1. Every task enters the hashes of its own lines in two filters: one for hashes
   seen once, one for hashes that were in the first already. No line and no hash
   leaves the task; the filters do, in compressed shards.
2. The filters of all tasks are merged shard by shard: what two tasks have both
   seen once has been seen twice. Only the second filter is kept. Its size
   follows the number of lines up to a bound, so what is broadcast is bounded
   whatever the input; a fuller filter suspects more lines, and the result stays
   the same.
3. Only lines that the second filter knows are shuffled, as 16-byte digests:
   a grouped minimum and maximum of doc_id confirms a repeat and chooses the
   document that keeps it (pre-aggregated, so a line of a third of all
   documents is a few rows for each task). The at most 1000 lines that more
   than a thousandth of the suspects share are broadcast to find their
   documents; the others are joined by digest.
4. The digests to drop join their documents, and the texts are rebuilt.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoply.llm.common import by_batch, saved, strides
from duoply.operators.order import fresh

FILTERS = pa.schema([("shard", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
BLANKS = b" \t\n\x0b\x0c\r"
SHARDS, PROBES = 128, 4
#: Bits of a filter for each line, and the least.
PER_LINE, LEAST_BITS = 16, 1 << 20


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    keys = (x.strip(BLANKS).lower() for x in (text or "").encode().split(b"\n"))
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None for k in keys]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, PROBES places in the shard's filter) of each hash."""
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    return (h >> np.uint64(57)).astype(np.int64), ((low[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _has(filters: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filters[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def enter(once: np.ndarray, twice: np.ndarray, h: np.ndarray, part: int) -> None:
    """Hashes into the two filters; a hash that comes more than once in h is seen twice."""
    h, n = np.unique(h, return_counts=True)
    shard, at = _places(h, part)
    at += (shard * part)[:, None]
    again = at[_has(once, at) | (n > 1)].ravel()
    np.bitwise_or.at(twice, again >> 3, (1 << (again & 7)).astype(np.uint8))
    at = at.ravel()
    np.bitwise_or.at(once, at >> 3, (1 << (at & 7)).astype(np.uint8))


def repeat_filter(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """The twice-seen filter of `bits` bits as one byte array of SHARDS parts."""
    size = bits // SHARDS // 8

    def fill(batches):
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for whole in batches:
            for batch in strides(whole):
                enter(once, twice, _hashes(k for x in batch.column(0).to_pylist() for k in {k for k in line_keys(x, least) if k is not None}), bits // SHARDS)
        rows = [k for k in range(SHARDS) if once[k * size : (k + 1) * size].any()]
        press = lambda x: [zlib.compress(x[k * size : (k + 1) * size], 1) for k in rows]
        yield pa.RecordBatch.from_pydict({"shard": rows, "once": press(once), "twice": press(twice)}, schema=FILTERS)

    def merge(batches):
        now, once, twice = None, None, None
        for batch in batches:
            for shard, *filters in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in filters)
                if shard == now:
                    twice |= b | (once & a)
                    once |= a
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"shard": [now], "filter": [zlib.compress(twice, 1)]})
                now, once, twice = shard, a.copy(), b.copy()
        if now is not None:
            yield pa.RecordBatch.from_pydict({"shard": [now], "filter": [zlib.compress(twice, 1)]})

    own = docs.select("text").mapInArrow(fill, "shard long, once binary, twice binary")
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for shard, packed in own.repartition(SHARDS, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, filter binary").collect():  # `bits` in all
        whole[shard * size : (shard + 1) * size] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return whole


def dedup_lines(docs: DataFrame, least: int = 10, most_bits: int = 1 << 27) -> DataFrame:
    """docs with the lines dropped that an earlier document has, plus n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys
    of `least` code points or more in two documents or more stay only in the
    smallest doc_id. A null or empty text is one empty line; rows with the same
    doc_id count as one document and keep their lines alike; a null doc_id
    holds no line, so its lines stay and make no others go. Columns n_lines and
    n_dropped of the input are replaced; all others stay, whatever their names. The filter has PER_LINE bits a line,
    `most_bits` at most.
    """
    spark, named = docs.sparkSession, docs.where(F.col("doc_id").isNotNull())
    lines = named.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, 1 << int(PER_LINE * lines - 1).bit_length()))
    part = bits // SHARDS
    known = spark.sparkContext.broadcast(repeat_filter(named, bits, least))

    def suspect(batch):
        ids, owner, keys = batch.column(0).to_pylist(), [], []
        for k, x in enumerate(batch.column(1).to_pylist()):
            own = {y for y in line_keys(x, least) if y is not None}
            keys += own
            owner += [k] * len(own)
        if not keys:
            return None
        shard, at = _places(_hashes(keys), part)
        found = np.flatnonzero(_has(known.value, at + (shard * part)[:, None]))
        return {"doc_id": [ids[owner[i]] for i in found], "line": [_digest(keys[i]) for i in found]}

    suspects = saved(by_batch(named.select("doc_id", "text"), suspect, f"doc_id {dict(docs.dtypes)['doc_id']}, line binary"))
    repeats = saved(suspects.groupBy("line").agg(F.min("doc_id").alias("_keeper"), F.max("doc_id").alias("_last"), F.count("*").alias("_n")).where("_keeper < _last").select("line", "_keeper", "_n"))
    often = F.col("_n") > max(1000, suspects.count() // 1000)  # so at most 1000 lines are; these are broadcast, and no task gets all their documents
    common = F.broadcast(repeats.where(often).drop("_n"))
    found = suspects.join(common, "line").union(suspects.join(common, "line", "left_anti").join(repeats.where(~often).drop("_n"), "line"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, gone_lines = fresh(own, 2)
    drops = found.where("doc_id > _keeper").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(gone_lines))
    joined = docs.select(own).join(drops, F.col("doc_id") == F.col(doc), "left").select(*own, gone_lines)

    def rebuild(batch):
        at, out = own.index("text"), []
        for x, gone in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist()):
            parts = (x or "").split("\n")
            if gone is None:
                out.append((x or "", len(parts), 0))
                continue
            gone = set(gone)
            keep = [p for p, k in zip(parts, line_keys(x, least)) if k is None or _digest(k) not in gone]
            out.append(("\n".join(keep), len(parts), len(parts) - len(keep)))
        text, n_lines, n_dropped = zip(*out)
        return dict(zip(own, batch.columns)) | {"text": text, "n_lines": n_lines, "n_dropped": n_dropped}

    return by_batch(joined, rebuild, T.StructType([*docs.select(own).schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
