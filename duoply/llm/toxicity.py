"""Toxicity by two class-conditional Kneser-Ney models of the letters of words.

P(letter | four letters before, class) discounts the class's own counts and
gives what is taken to a Kneser-Ney model of lower order that both classes
share, built from continuation counts of both. A rare expression thus differs
between classes only by what its letters have shown, and one that neither class
knows doesn't differ at all. The two log-likelihoods of each word are compared,
normalised by length, and the document's score is calibrated from the largest
difference, the largest sum and the mean difference, by logistic regression on
labelled documents that the counts have not seen.

Symbols take five bits: 0 a word's border, 1-26 a-z, 27-31 other letters by
code point, so five of them index a dense table and what is broadcast is bounded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoply.llm.common import by_batch, held_out, sampled, strides

ORDER, SLICE = 5, 1 << 18


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    out = np.array([27 + c % 5 if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def keys(texts: list[str | None]):
    """Slices of whole texts: (five-symbol key at each letter and at each word's end, index of the word, text of each word, whether the first word goes on from the slice before, whether the last goes on in the next). A text over the slice size comes in pieces that overlap by four characters, which are only context."""
    held, owner, size = [], [], 0
    for k, x in enumerate(texts):
        x = (x or "").lower()
        if size and size + len(x) > SLICE:
            yield _keys(held, owner, 0, False)
            held, owner, size = [], [], 0
        if len(x) <= SLICE:
            held.append(x)
            owner.append(k)
            size += len(x)
            continue
        for at in range(0, len(x), SLICE):
            lead = min(at, ORDER - 1)
            yield _keys([x[at - lead : at + SLICE]], [k], lead, at + SLICE < len(x))
    if held:
        yield _keys(held, owner, 0, False)


def _keys(held: list[str], owner: list[int], lead: int, more: bool):
    codes = np.frombuffer(("\n".join(held) + "\n").encode("utf-32-le"), dtype=np.uint32)
    s = _symbols()[codes].astype(np.int32)
    letter = s > 0
    end = ~letter & np.concatenate([[False], letter[:-1]])
    if more:
        end[-1] = False
    start = letter & ~np.concatenate([[False], letter[:-1]])
    here = np.flatnonzero(letter | end)
    here = here[here >= lead]
    since = here - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))[here]
    key = s[here].copy()
    for j in range(1, ORDER):
        key |= np.where(since >= j, s[np.maximum(here - j, 0)], 0) << (5 * j)
    word = (np.cumsum(start) - 1)[here]
    text = np.array(owner)[np.searchsorted(np.cumsum([len(x) + 1 for x in held]), np.flatnonzero(start), side="right")]
    if len(here):
        text = text[word[0] : word[-1] + 1]
        return key, word - word[0], text, bool(lead) and bool(letter[lead - 1]), more and bool(letter[-2])
    return key, word, text[:0], False, False


def kneser_ney(key: np.ndarray, n: np.ndarray, classes: int = 2, discount: float = 0.75) -> np.ndarray:
    """log P(class 1) - log P(class 0) of each five-symbol key; n has a row of counts for each key.

    Returns it for the given keys, and then for their contexts followed by a symbol that the context has in neither class.
    """
    seen, lower = key, (n > 0).any(axis=1).astype(np.int64)
    # the shared model: of each order, continuation counts are the different symbols that stand in front
    levels = []
    for j in range(ORDER - 1, 0, -1):
        seen, back = np.unique(seen & ((1 << (5 * j)) - 1), return_inverse=True)
        lower = np.bincount(back, weights=lower).astype(np.int64) if j == ORDER - 1 else np.bincount(back, minlength=len(seen)).astype(np.int64)
        levels.append((seen, lower))
    p = np.full(1, 1 / 32)
    known = np.zeros(1, dtype=np.int64)
    for j, (grams, count) in zip(range(1, ORDER), reversed(levels)):
        context, back = np.unique(grams >> 5, return_inverse=True)
        total, kinds = np.bincount(back, weights=count), np.bincount(back)
        below = p[np.searchsorted(known, grams & ((1 << (5 * (j - 1))) - 1))] if j > 1 else p[np.zeros(len(grams), dtype=int)]
        p = (count - discount) / total[back] + discount * kinds[back] / total[back] * below
        known = grams
    shared = p[np.searchsorted(known, key & ((1 << (5 * (ORDER - 1))) - 1))]
    context, back = np.unique(key >> 5, return_inverse=True)
    logs, rest = [], []
    for c in range(classes):
        total, kinds = np.bincount(back, weights=n[:, c]), np.bincount(back, weights=n[:, c] > 0)
        some = np.maximum(total, 1)
        left = np.where(total > 0, discount * kinds / some, 1.0)
        logs.append(np.log(np.maximum(n[:, c] - discount, 0) / some[back] + left[back] * shared))
        rest.append(np.log(left))
    return logs[1] - logs[0], context, rest[1] - rest[0]


class Model:
    def __init__(self, key, gain, context, rest, weights):
        self.parts, self.weights, self._table = (key, gain.astype(np.float16), context, rest.astype(np.float16)), weights, None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    @property
    def table(self) -> np.ndarray:
        """Gain of each five-symbol key; filled in each worker."""
        if self._table is None:
            key, gain, context, rest = self.parts
            self._table = np.zeros((1 << (5 * ORDER - 5), 32), dtype=np.float16)
            self._table[context] = rest[:, None]
            self._table.reshape(-1)[key] = gain
            self._table = self._table.reshape(-1)
        return self._table

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: largest gain a symbol of a word, largest sum of a word, mean gain a symbol."""
        best, most, total, n = (np.zeros(len(texts)) for _ in range(4))
        held = np.zeros(2)  # sum and size of a word that the last slice has not ended
        for key, word, text, goes_on, unended in keys(texts):
            if not len(text):
                continue
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sums, size = np.add.reduceat(self.table[key].astype(np.float64), first), np.diff(np.append(first, len(key)))
            if goes_on:
                sums[0], size[0] = sums[0] + held[0], size[0] + held[1]
            if unended:
                held = np.array([sums[-1], size[-1]])
                sums, size, text = sums[:-1], size[:-1], text[:-1]
                if not len(text):
                    continue
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            at = text[edge]
            best[at] = np.maximum(best[at], np.maximum.reduceat(sums / (size + 2), edge))
            most[at] = np.maximum(most[at], np.maximum.reduceat(sums, edge))
            total[at] += np.add.reduceat(sums, edge)
            n[at] += np.add.reduceat(size, edge)
        return np.stack([best, most, total / np.maximum(n, 1)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        middle, spread, w = self.weights
        return 1 / (1 + np.exp(-np.clip((self.features(texts) - middle) / spread @ w[:-1] + w[-1], -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
    """(means, spreads, weights with bias) of a ridge logistic regression by Newton steps."""
    middle, spread = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    w, hold = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w)
    return middle, spread, w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000) -> Model:
    """A model from documents outside the held-out fold with a label of 0 or 1 (a document labelled both is 1).

    About `most` documents of each label, or all, are learned from; that bounds
    what is broadcast (ids) and what the driver holds (counts of five-symbol
    keys). Repeated rows of a document teach as often as they come. Four of five of them give counts, the fifth the calibration.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    ids = sampled(known, "_y", most).select(F.col("doc_id").alias("_id"), "_y", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0).alias("_check"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "_y", "_check")

    def count(batches):
        import pyarrow as pa

        key, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in strides(batch):
                y = part.column(1).to_numpy().astype(np.int64)
                for k, word, text, _, _ in keys(part.column(0).to_pylist()):
                    if not len(text):
                        continue
                    new, m = np.unique((y[text][word] << 25) + k, return_counts=True)
                    key, back = np.unique(np.concatenate([key, new]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([n, m])).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"key": key, "n": n})

    rows = texts.where("not _check").select("text", "_y").mapInArrow(count, "key long, n long").groupBy(F.col("key").bitwiseAND(F.lit((1 << 25) - 1)).alias("gram")).agg(F.sum(F.when(F.col("key") < 1 << 25, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("key") >= 1 << 25, F.col("n")).otherwise(0)).alias("n1")).toPandas().sort_values("gram")
    model = Model(*_gains(rows), (np.zeros(3), np.ones(3), np.zeros(4)))
    shared = spark.sparkContext.broadcast(model)

    def features(batch):
        x = shared.value.features(batch.column(0).to_pylist())
        return {"y": batch.column(1), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}

    check = by_batch(texts.where("_check").select("text", "_y"), features, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    model.weights = logistic(check[["a", "b", "c"]].to_numpy(), check["y"].to_numpy())
    return model


def _gains(rows):
    if not len(rows):
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros(0), none, np.zeros(0)
    key = rows["gram"].to_numpy()
    return key, *kneser_ney(key, rows[["n0", "n1"]].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text, of any length; null and empty texts have no word and get the score of no evidence; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        p = shared.value.score(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
