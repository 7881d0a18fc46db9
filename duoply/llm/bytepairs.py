"""Byte-level BPE in both directions, as DuckDB queries over the words of a batch.

Encoding: the distinct words of a batch become one row a byte (word, position,
token), and a recursive query joins neighbours to the merge table, contracts
each word's leftmost pair of least rank, and repeats until no pair is left.
Decoding: rows (text, position, token) join the vocabulary, and an ordered
aggregation puts their bytes together. Both run inside Spark's tasks, a batch
at a time, in one DuckDB connection of a Python worker, which has no more than
`MEMORY` and writes no files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from duoply.llm import bpe
from duoply.llm.common import by_batch

MEMORY = "500MB"
#: Characters of text, and tokens, that are worked on together.
SLICE, TOKENS = 1 << 21, 1 << 19
#: Bytes up to which a word is contracted one pair a turn, beside others; longer words keep no earlier turns.
SHORT = 64
#: Bytes of short words in one query.
TOGETHER = 1 << 20
#: Words whose tokens a worker remembers; then it starts anew.
KNOWN = 1 << 19

#: Each row names its neighbour (other, the token at nxt), so a turn needs no sort.
CONTRACT = """
WITH RECURSIVE s(turn, word, pos, id, other, nxt) AS (
  SELECT 0, word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos), pos + 1 FROM start
  UNION ALL
  (WITH best AS (
     SELECT word, min((m.rank::BIGINT << 16) | (pos << 8) | nxt) AS best FROM s JOIN merges m ON m.a = id AND m.b = other GROUP BY word),
   pair AS (SELECT word, best >> 16 AS made, (best >> 8) & 255 AS here, best & 255 AS gone FROM best),
   linked AS (SELECT p.*, s.other AS beyond, s.nxt AS behind FROM pair p JOIN s ON s.word = p.word AND s.pos = p.gone)
   SELECT s.turn + 1, s.word, s.pos,
     CASE WHEN s.pos = here THEN made ELSE s.id END,
     CASE WHEN s.pos = here THEN beyond WHEN s.nxt = here THEN made ELSE s.other END,
     CASE WHEN s.pos = here THEN behind ELSE s.nxt END
   FROM s JOIN linked USING (word) WHERE s.pos <> gone)),
last AS (SELECT word, max(turn) AS turn FROM s GROUP BY word)
SELECT word, pos, id FROM s JOIN last USING (word, turn) ORDER BY word, pos"""

#: The same for long words: rows are changed in place. All separate pairs of least rank go in one turn, unless the token that they
#: make can stand in a pair of lower rank; then the leftmost goes alone. Of pairs that overlap, every other one counts from the left.
CONTRACT_LONG = """
WITH RECURSIVE t(word, pos, id, nxt) USING KEY (word, pos) AS (
  SELECT word, pos, id, pos + 1 FROM start
  UNION
  (WITH pair AS (
     SELECT l.word, l.pos, l.nxt, r.nxt AS behind, m.rank, m.early
     FROM recurring.t l JOIN recurring.t r ON r.word = l.word AND r.pos = l.nxt JOIN merges m ON m.a = l.id AND m.b = r.id),
   least AS (SELECT word, min(rank) AS rank FROM pair GROUP BY word),
   hits AS (
     SELECT pair.*, row_number() OVER w AS n, pos IS DISTINCT FROM lag(nxt) OVER w AS apart
     FROM pair JOIN least USING (word, rank) WINDOW w AS (PARTITION BY word ORDER BY pos)),
   placed AS (SELECT *, n - max(CASE WHEN apart THEN n END) OVER (PARTITION BY word ORDER BY pos) AS place FROM hits),
   taken AS (SELECT * FROM placed WHERE place % 2 = 0 AND (n = 1 OR NOT early))
   SELECT word, pos, rank, behind FROM taken UNION ALL SELECT word, nxt, -1, NULL FROM taken))
SELECT word, pos, id FROM t WHERE id >= 0 ORDER BY word, pos"""

DECODE = """
SELECT text, unhex(string_agg(hex, '' ORDER BY pos)) AS data FROM tokens JOIN vocabulary USING (id) GROUP BY text ORDER BY text"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Whole texts in slices that end between pre-tokens: (slices, the text of each), about SLICE characters at a time."""
    held, owner, size = [], [], 0
    for k, x in enumerate(texts):
        for piece in bpe.slices(x or ""):
            if held and size + len(piece) > SLICE:
                yield held, owner
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(k)
            size += len(piece)
    if held:
        yield held, owner


def words_of(parts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all parts as binary, part of each). A part over bpe.SLICE is one run that has no safe place to cut (bpe.slices), and comes alone."""
    if len(parts) == 1 and len(parts[0]) > bpe.SLICE:
        found = bpe.endless(parts[0])
        return pa.array(found, type=pa.binary()), np.zeros(len(found), dtype=np.int64)
    whole = "".join(parts)
    codes, data = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32), whole.encode()
    chars = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.flatnonzero(bpe.quick_cuts(bpe.classes()[codes], chars))
    part = np.searchsorted(np.cumsum(chars), begin, side="right")
    wide = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])
    ends = np.append(wide[begin], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]), part


def spread(offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i] + size[i] - 1 of all i, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - size), size)


class Coder:
    """Merge table and vocabulary of one file in a DuckDB connection, with the words that it remembers."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        pairs = np.array([(a, b, r) for word, r in self.ranks.items() for i in range(1, len(word)) if (a := self.ranks.get(word[:i])) is not None and (b := self.ranks.get(word[i:])) is not None], dtype=np.int32).reshape(-1, 3)
        a, b, rank = np.ascontiguousarray(pairs.T)
        early = np.isin(rank, np.concatenate([a[rank < a], b[rank < b]]))
        self._table("pairs", a=a, b=b, rank=rank, early=early)
        self._table("tokens", id=np.array(list(self.ranks.values()), dtype=np.int32), hex=[w.hex() for w in self.ranks])
        self.con.execute("CREATE TABLE merges AS SELECT * FROM pairs; CREATE TABLE vocabulary AS SELECT * FROM tokens")
        self.forget()

    def _table(self, name: str, **columns) -> None:
        self.con.register(name, pa.table(columns))

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def contract(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, how many each has)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(word)) - (np.cumsum(size) - size)[word]
        self._table("start", word=word.astype(np.int32), pos=pos.astype(np.int32), id=self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)])
        found = self.con.execute(query).fetchnumpy()
        return np.asarray(found["id"], dtype=np.int32), np.bincount(np.asarray(found["word"]), minlength=len(words))

    def learn(self, words: list[bytes]) -> None:
        """Remembers the tokens of new words: those of the vocabulary as they are, others by contraction."""
        whole = [w for w in words if w in self.ranks]
        rest = sorted((w for w in words if w not in self.ranks), key=len)
        ids, size = [self.ids, np.array([self.ranks[w] for w in whole], dtype=np.int32)], [self.size, np.ones(len(whole), dtype=np.int64)]
        behind = np.cumsum([len(w) for w in rest])
        groups = np.split(np.arange(len(rest)), np.flatnonzero(np.diff(behind // TOGETHER)) + 1) if rest else []
        for group in groups:
            few = [rest[i] for i in group]
            short = sum(len(w) <= SHORT for w in few)
            for some, query in ((few[:short], CONTRACT), (few[short:], CONTRACT_LONG)):
                if some:
                    more, n = self.contract(some, query)
                    ids.append(more)
                    size.append(n)
        self.known.update({w: i for i, w in enumerate([*whole, *rest], len(self.known))})
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after another, how many each part has)."""
        found, part = words_of(parts)
        if not len(found):
            return np.zeros(0, dtype=np.int32), np.zeros(len(parts), dtype=np.int64)
        seen = found.dictionary_encode()
        words = seen.dictionary.to_pylist()
        if len(self.known) + len(words) > KNOWN:
            self.forget()
        self.learn([w for w in words if w not in self.known])
        which = np.array([self.known[w] for w in words], dtype=np.int64)[seen.indices.to_numpy()]
        size = self.size[which]
        ids = self.ids[spread((np.cumsum(self.size) - self.size)[which], size)]
        if len(self.known) > KNOWN:  # one batch alone has so many
            self.forget()
        return ids, np.bincount(part, size, len(parts)).astype(np.int64)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Bytes of runs of ids, size[i] ids each; TOKENS ids at a time. An id that the vocabulary lacks is an error."""
        out: list[list[bytes]] = [[] for _ in size]
        run = np.repeat(np.arange(len(size)), size)
        for a in range(0, len(ids), TOKENS):
            b = min(len(ids), a + TOKENS)
            self._table("tokens", text=run[a:b], pos=np.arange(b - a, dtype=np.int32), id=ids[a:b])
            if not self.con.execute("SELECT count(*) = 0 FROM tokens ANTI JOIN vocabulary USING (id)").fetchall()[0][0]:
                raise ValueError("an id has no token")
            found = self.con.execute(DECODE).fetchnumpy()
            for k, data in zip(found["text"].tolist(), found["data"]):
                out[k].append(bytes(data))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per Python worker and file."""
    return Coder(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every whole text: each match of the word pattern (bpe.PATTERN) is encoded by itself, without special tokens.

    No row moves between tasks. A null text has no ids, as the empty one;
    repeated rows stay; other columns are not read. Texts are read in slices
    between pre-tokens, so beside a text and its ids a worker holds a bounded
    amount; a single word longer than a slice is contracted as a whole.
    """

    def run(batch):
        texts = batch.column(1).to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for parts, owner in pieces(texts):
            ids, size = coder(path).encode(parts)
            for k, some in zip(owner, np.split(ids, np.cumsum(size)[:-1])):
                out[k].append(some)
        return {key: batch.column(0), "ids": [np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in out]}

    return by_batch(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, data binary): the bytes of each row's ids, a null list as an empty one. Not every list of ids is UTF-8, so bytes they stay."""

    def run(batch):
        many = batch.column(1)
        size = pc.fill_null(pc.list_value_length(many), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return {key: batch.column(0), "data": coder(path).decode(many.flatten().to_numpy(zero_copy_only=False).astype(np.int32), size)}

    return by_batch(rows.select(key, ids), run, f"{key} {dict(rows.dtypes)[key]}, data binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by spaces, and of the bytes that those ids decode to. As encode() and decode(), with neither ids nor bytes of a long text held whole."""

    def run(batch):
        texts = batch.column(1).to_pylist()
        n = np.zeros(len(texts), dtype=np.int64)
        digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        for parts, owner in pieces(texts):
            ids, size = coder(path).encode(parts)
            joined = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(ids).cast(pa.string())), " ").to_pylist()
            for k, more, line, data in zip(owner, size.tolist(), joined, coder(path).decode(ids, size)):
                digests[k][0].update((b" " if n[k] and more else b"") + line.encode())
                digests[k][1].update(data)
                n[k] += more
        return {key: batch.column(0), "n_tokens": n, "ids_sha256": [a.hexdigest() for a, _ in digests], "decoded_sha256": [b.hexdigest() for _, b in digests]}

    return by_batch(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
