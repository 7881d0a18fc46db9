"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (anything else is a
word border), as relative frequency times inverse document frequency. Weights
are learned by FTRL-proximal with elastic-net penalties, so most of them are
exactly zero, and a temperature is fitted on documents that training left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoply.llm.common import by_batch, held_out, sampled, strides

BITS, SCALE, SLICE = 16, 30.0, 1 << 18
UNKNOWN = "und"
#: With fewer documents to calibrate with, no text with a letter is called foreign; a text is strange from so many times the rarity of the strangest taught one.
ENOUGH, STRANGE = 20, 1.25


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None]):
    """Slices of whole texts: (index of the text, slot of each n-gram); a text over the slice size comes in several pieces that overlap by two characters."""
    held, owner, size = [], [], 0
    for k, x in enumerate(texts):
        x = (x or "").lower()
        for i in range(0, len(x), SLICE):
            held.append(x[max(0, i - 2) : i + SLICE])
            owner.append((k, min(i, 2)))
            size += len(held[-1])
            if size >= SLICE:
                yield _grams(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _grams(held, owner)


def _grams(held: list[str], owner: list[tuple[int, int]]):
    codes = np.frombuffer("\n\n".join(held).encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[codes]
    sizes = np.array([len(x) + 2 for x in held])
    piece = np.repeat(np.arange(len(held)), sizes)[: len(codes)]
    inside = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[piece]
    new = letter & (inside >= np.array([o[1] for o in owner])[piece])  # what an earlier piece has counted is only context
    c = np.where(letter, codes, 0).astype(np.uint32)
    one, two = (np.concatenate([np.zeros(n, dtype=np.uint32), c[:-n]]) for n in (1, 2))
    at = np.flatnonzero(new)
    a, b, d = c[at] * np.uint32(0x9E3779B1), one[at] * np.uint32(0x85EBCA77), two[at] * np.uint32(0xC2B2AE3D)
    slots = np.stack([a + np.uint32(1), a + b + np.uint32(2), a + b + d + np.uint32(3)])
    slots = (slots ^ (slots >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.array([o[0] for o in owner])[piece[at]], ((slots ^ (slots >> np.uint32(12))) >> np.uint32(32 - BITS)).astype(np.int32)


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each slot, and all documents. Tasks send sums of blocks of slots, so what moves doesn't depend on the texts."""
    blocks = 64

    def count(batches):
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        seen = np.zeros(1 << BITS, dtype=bool)
        for batch in (part for whole in batches for part in strides(whole)):
            texts = batch.column(0).to_pylist()
            n += len(texts)
            last = None
            for text, slots in grams(texts):
                for k in np.unique(text):
                    if k != last:
                        df += seen
                        seen[:] = False
                        last = k
                    seen[slots[:, text == k] if len(texts) == 1 else slots[:, np.searchsorted(text, k) : np.searchsorted(text, k, side="right")]] = True
            df += seen
            seen[:] = False
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"block": list(range(blocks)), "sums": [x.tobytes() for x in df.reshape(blocks, -1)], "n": [n] * blocks}, schema=pa.schema([("block", pa.int32()), ("sums", pa.binary()), ("n", pa.int64())]))

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "sums": [sum(np.frombuffer(x, dtype=np.int64) for x in pdf["sums"]).tobytes()], "n": [pdf["n"].sum()]})

    rows = docs.select("text").mapInArrow(count, "block int, sums binary, n long").groupBy("block").applyInPandas(add, "block int, sums binary, n long").collect()
    out = np.zeros((blocks, (1 << BITS) // blocks), dtype=np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.sums, dtype=np.int64)
    return out.ravel(), max([0, *(r.n for r in rows)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Weights (slots + bias, classes) from rows (class, slots, values)."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            y, slots, values = rows[k]
            slots, values = np.append(slots, 1 << BITS), np.append(values, 1.0)
            w = weights(slots)
            p = _softmax(values @ w)
            p[y] -= 1
            g = values[:, None] * p
            moved = n[slots] + g * g
            z[slots] += g - (np.sqrt(moved) - np.sqrt(n[slots])) / alpha * w
            n[slots] = moved
    return weights(slice(None))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss against smoothed truth (Platt's: of n documents of a label, (n + 1) / (n + 2) for the label, the rest for the others), so that documents which are all told apart don't make it vanish."""
    if not len(y):
        return 1.0
    right = (np.bincount(y, minlength=scores.shape[1])[y] + 1) / (np.bincount(y, minlength=scores.shape[1])[y] + 2)
    truth = np.repeat((1 - right)[:, None] / max(1, scores.shape[1] - 1), scores.shape[1], axis=1)
    truth[np.arange(len(y)), y] = right
    tries = np.exp(np.linspace(-5, 5, 401))
    return float(tries[np.argmin([-(truth * np.log(_softmax(scores / t) + 1e-300)).sum(axis=1).mean() for t in tries])])


class Model:
    """`rarity` is the inverse document frequency of each slot; texts less sure than `least`, or of a mean rarity over `strangest`, are in none of the languages."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, heat: float, rarity: np.ndarray, least: float, strangest: float):
        self.labels, self.table, self.bias, self.heat = labels, table, bias, heat
        self.rarity, self.least, self.strangest = rarity, least, strangest
        self.both = np.column_stack([table, rarity]).astype(np.float32)

    def _means(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean row of table over the n-grams of each text, and its letters."""
        total, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
        for text, slots in grams(texts):
            if not len(text):
                continue
            first = np.flatnonzero(np.diff(text, prepend=-1))
            sums = table[slots[0]]
            for more in slots[1:]:
                sums += table[more]
            np.add.at(total, text[first], np.add.reduceat(sums, first, axis=0))
            np.add.at(n, text[first], np.diff(np.append(first, len(text))))
        return total / np.maximum(3 * n, 1)[:, None], n

    def _probabilities(self, means: np.ndarray) -> np.ndarray:
        return _softmax((means * SCALE + self.bias) / self.heat)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability; `und` and 0 where a text has no letter."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        means, n = self._means(texts, self.table)
        p = self._probabilities(means)
        best = p.argmax(axis=1)
        return [self.labels[b] if m else UNKNOWN for b, m in zip(best, n)], np.where(n > 0, p[np.arange(len(texts)), best], 0.0)

    def known(self, texts: list[str | None]) -> np.ndarray:
        """True where a text has a letter and may be in one of the languages; where no label was learned, a letter is enough."""
        means, n = self._means(texts, self.both)
        if not self.labels:
            return n > 0
        return (n > 0) & (self._probabilities(means[:, :-1]).max(axis=1) >= self.least) & (means[:, -1] <= self.strangest)


def fit(learn: DataFrame, label: str = "lang", most: int = 1500) -> Model:
    """A model from rows (doc_id, text, label). Document frequencies count all rows; weights, temperature and the limits of what is known come from about `most` whole texts of each label (the 256 most frequent ones, see sampled), the bound of what the driver holds.

    The least probability lies over that of a blind guess by an eighth of what
    the least sure calibration document has over it; the greatest rarity is
    STRANGE times that of the strangest document, each without its own share
    in the document frequencies.
    """
    learn = learn.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    df, n = _document_frequency(learn)
    idf = np.log((n + 1) / (df + 1)) + 0.05

    def features(batch):
        texts = batch.column(1).to_pylist()
        out = []
        for x in texts:
            found = np.zeros(1 << BITS, dtype=np.int32)
            for _, slots in grams([x]):
                found += np.bincount(slots.ravel(), minlength=1 << BITS).astype(np.int32)
            slots = np.flatnonzero(found).astype(np.int32)
            out.append((slots.tobytes(), found[slots].tobytes()))
        return {"doc_id": batch.column(0), "label": batch.column(2), "slots": [o[0] for o in out], "counts": [o[1] for o in out]}

    picked = sampled(learn.select("doc_id", "text", F.col(label).alias("label")), "label", most)
    rows = by_batch(picked, features, f"doc_id {dict(learn.dtypes)['doc_id']}, label string, slots binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.slots))
    labels = sorted({r.label for r in rows})
    data, strange = [], [0.0]
    for r in rows:
        slots, counts = np.frombuffer(r.slots, dtype=np.int32), np.frombuffer(r.counts, dtype=np.int32)
        strange.append(float(counts / max(1, counts.sum()) @ (np.log(n / np.maximum(df[slots], 1)) + 0.05)))
        data.append((labels.index(r.label), slots, counts / max(1, counts.sum()) * idf[slots] * SCALE))
    check = [k % 5 == 0 for k in range(len(data))]
    w = ftrl([d for d, c in zip(data, check) if not c] or data, max(1, len(labels)))
    scores = np.array([np.append(v, 1.0) @ w[np.append(s, 1 << BITS)] for (_, s, v), c in zip(data, check) if c])
    heat = temperature(scores, np.array([y for (y, _, _), c in zip(data, check) if c])) if len(labels) > 1 else 1.0
    least, strangest = 0.0, np.inf
    if len(scores) >= ENOUGH:
        least = (7 / len(labels) + float(_softmax(scores / heat).max(axis=1).min())) / 8
        strangest = STRANGE * max(strange)
    return Model(labels, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], heat, idf.astype(np.float32), least, strangest)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text. Null texts and texts without a letter are `und` with score 0; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found, score = shared.value.predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": found, "score": score}

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text may be in one of the languages (Model.known)."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batch):
        import pyarrow as pa

        stay = pa.array(shared.value.known(batch.column(at).to_pylist()))
        return dict(zip(batch.schema.names, (c.filter(stay) for c in batch.columns)))

    return by_batch(docs, run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may teach: those outside the held-out fold."""
    return docs.where(~held_out(F.col("doc_id")))
