"""Evidence from log-probabilities of symbols: scores of candidate strings, decoding, constrained ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoply import config as C

#: Symbols of the test data's alphabet; symbol 0 is the blank, so these are 1 and up.
LETTERS = "abcdefghijklmno"
#: Confidence of a reading that the grammar doesn't accept, and share of one that only the lenient grammar accepts (fixed values).
PARTIAL_CONF, LENIENT_SHARE = 0.1, 0.5


def log_frames(values: np.ndarray, frames: int, symbols: int) -> np.ndarray:
    """(cells, frames, symbols) of log-probabilities from raw scores (cells, frames * symbols)."""
    z = values.reshape(-1, frames, symbols).astype(np.float64)
    z = z - z.max(axis=2, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=2, keepdims=True))


def _symbols(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of each text, padded with 0; lengths). A letter that the alphabet lacks is -1."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    known = np.array([ord(c) for c in alphabet], dtype=np.uint32)
    order = np.argsort(known)
    at = np.searchsorted(known[order], codes).clip(0, max(0, len(known) - 1))
    found = np.where(known[order][at] == codes, order[at] + 1, -1) if len(known) else np.full(len(codes), -1)
    out = np.zeros((len(texts), int(size.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = found
    return out, size


def ctc_scores(logp: np.ndarray, texts: list[str], alphabet: str = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """(best path, sum over all paths) of text i in logp[i] (frames, symbols), for many texts at once; NaN if a text has an unknown symbol or doesn't fit the frames.

    A text's states are its symbols with blanks around them, padded to the
    longest text; a state is reached from itself, the one before, and from the
    symbol before the blank if that is another one.
    """
    n, frames, symbols = logp.shape
    ids, size = _symbols(texts, alphabet)
    repeats = ((ids[:, 1:] == ids[:, :-1]) & (np.arange(1, ids.shape[1]) < size[:, None])).sum(axis=1) if ids.shape[1] else 0
    fits = (ids >= 0).all(axis=1) & (ids < symbols).all(axis=1) & (size + repeats <= frames)
    states = np.zeros((n, 2 * ids.shape[1] + 1), dtype=np.int64)
    states[:, 1::2] = np.where((ids > 0) & (ids < symbols), ids, 0)
    skip = np.zeros(states.shape, dtype=bool)
    skip[:, 3::2] = states[:, 3::2] != states[:, 1:-2:2]
    first = np.take_along_axis(logp[:, 0], states, axis=1)
    first[:, 2:] = -np.inf
    best, total = first, first.copy()
    back = lambda v, k: np.pad(v, ((0, 0), (k, 0)), constant_values=-np.inf)[:, : v.shape[1]]
    with np.errstate(invalid="ignore"):
        for t in range(1, frames):
            row = np.take_along_axis(logp[:, t], states, axis=1)
            best = np.maximum(np.maximum(best, back(best, 1)), np.where(skip, back(best, 2), -np.inf)) + row
            total = np.logaddexp(np.logaddexp(total, back(total, 1)), np.where(skip, back(total, 2), -np.inf)) + row
    last = 2 * size[:, None]
    end = lambda v, k: np.where(last[:, 0] >= k, np.take_along_axis(v, (last - k).clip(0), axis=1)[:, 0], -np.inf)
    return np.where(fits, np.maximum(end(best, 0), end(best, 1)), np.nan), np.where(fits, np.logaddexp(end(total, 0), end(total, 1)), np.nan)


def _by_shape(f: pd.DataFrame, rows: int = 4096):
    """(row numbers, log-probabilities) of rows of one shape, at most `rows` at a time; rows whose values don't have their shape are left out."""
    shape = f[["frames", "symbols"]].to_numpy(dtype=np.int64)
    size = f["values"].map(len).to_numpy(dtype=np.int64)
    for frames, symbols in np.unique(shape, axis=0).tolist():
        who = np.flatnonzero((shape[:, 0] == frames) & (shape[:, 1] == symbols) & (size == frames * symbols) & (size > 0))
        for a in range(0, len(who), rows):
            some = who[a : a + rows]
            yield some, log_frames(np.stack(f["values"].to_numpy()[some]), frames, symbols)


def score_candidates(cells: DataFrame, candidates: DataFrame, alphabet: str = LETTERS, key: str = "cell") -> DataFrame:
    """(key, text, best, total) for cells(key, frames, symbols, values), as sources.games.read_logits gives them, and candidates(key, text). Scores are null for texts that can't be scored, and where values don't have the cell's shape."""

    def run(frames):
        for f in frames:
            best, total, texts = np.full(len(f), np.nan), np.full(len(f), np.nan), f["text"].tolist()
            for who, logp in _by_shape(f):
                best[who], total[who] = ctc_scores(logp, [texts[i] for i in who.tolist()], alphabet)
            yield pd.DataFrame({key: f[key], "text": f["text"], "best": best, "total": total})

    joined = cells.select(key, "frames", "symbols", "values").join(candidates.where("text is not null").select(key, "text"), key)
    scored = joined.mapInPandas(run, f"{key} {dict(cells.dtypes)[key]}, text string, best double, total double")
    return scored.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("best", "total")})


class Grammar:
    """Texts of some shapes as a table of states: next[state, symbol] is the state behind a symbol, -1 if no text goes on so.

    A shape is a list of (letters, fewest, most): so many of these letters, one
    after another. State 0 is the beginning.
    """

    def __init__(self, shapes: list[list[tuple[str, int, int]]], alphabet: str = LETTERS):
        def closed(places: set) -> frozenset:
            """places (shape, step, how many of the step are there), and all that are reached without a letter."""
            todo, out = list(places), set()
            while todo:
                if (p := todo.pop()) not in out:
                    out.add(p)
                    shape, step, n = p
                    if step < len(shapes[shape]) and n >= shapes[shape][step][1]:
                        todo.append((shape, step + 1, 0))
            return frozenset(out)

        start = closed({(k, 0, 0) for k in range(len(shapes))})
        number, todo, rows = {start: 0}, [start], []
        for state in todo:
            row = [-1]
            for letter in alphabet:
                to = closed({(k, i, n + 1) for k, i, n in state if i < len(shapes[k]) and letter in shapes[k][i][0] and n < shapes[k][i][2]})
                if to and to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to] if to else -1)
            rows.append(row)
        self.next = np.array(rows, dtype=np.int64)
        self.whole = np.array([any(i == len(shapes[k]) for k, i, _ in state) for state in todo])

def any_text(alphabet: str) -> Grammar:
    """Every text of an alphabet."""
    own = Grammar([], alphabet)
    own.next, own.whole = np.array([[-1] + [0] * len(alphabet)]), np.array([True])
    return own


class Texts:
    """Texts by number, each a shorter text and a letter; 0 is the empty one. The numbers of a batch, not of its cells, so that cells share them."""

    def __init__(self, symbols: int):
        self.symbols, self.key, self.id = symbols, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.parent, self.letter, self.n = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of texts by parent * symbols + letter, -1 where a text has none."""
        if not len(self.key):
            return np.full(key.shape, -1, dtype=np.int64)
        at = np.searchsorted(self.key, key).clip(0, len(self.key) - 1)
        return np.where(self.key[at] == key, self.id[at], -1)

    def add(self, key: np.ndarray) -> None:
        new = np.unique(key)
        new = new[self.find(new) < 0]
        self.parent.append(new // self.symbols)
        self.letter.append(new % self.symbols)
        at = np.searchsorted(self.key, new)
        self.key, self.id = np.insert(self.key, at, new), np.insert(self.id, at, self.n + np.arange(len(new)))
        self.n += len(new)

    def strings(self, ids: np.ndarray, alphabet: str) -> list[str]:
        parent, letter, out = np.concatenate(self.parent).tolist(), np.concatenate(self.letter).tolist(), []
        for i in ids.tolist():
            text = ""
            while i:
                text, i = alphabet[letter[i] - 1] + text, parent[i]
            out.append(text)
        return out


def beam_search(logp: np.ndarray, grammar: Grammar, width: int = 15, alphabet: str = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, Texts]:
    """(text, state, score) of each cell's `width` best hypotheses, best first, for all cells at once; unused places have a score of -inf.

    A hypothesis is a text and the last symbol; a blank or the last symbol again
    leaves the text as it is, another symbol adds its letter if the grammar goes
    on so. Hypotheses of one text and last symbol are merged by the larger score
    (at most three meet, so four times `width` candidates are enough to fill the
    beam). Scores that are equal to nine digits are ordered by text, compared by
    as many letters as fit 62 bits.
    """
    n, frames, symbols = logp.shape
    letters = min(symbols, len(alphabet) + 1)
    step = grammar.next[:, :letters]
    texts = Texts(symbols)
    text, last, state, head, size = (np.zeros((n, 1), dtype=np.int64) for _ in range(5))
    bits = symbols.bit_length()
    score, rows = np.zeros((n, 1)), np.arange(n)[:, None]
    symbol = np.arange(letters)
    for t in range(frames):
        same = (symbol == 0) | (symbol == last[:, :, None])
        to = np.where(same, state[:, :, None], step[state])
        p = np.where(to >= 0, score[:, :, None] + logp[:, t, None, :letters], -np.inf).reshape(n, -1)
        most = min(p.shape[1], 4 * width)
        pick = np.argpartition(-p, most - 1, axis=1)[:, :most]
        room = 62 - bits * (size[rows, pick // letters] + 1)
        heads = head[rows, pick // letters] | np.where(same.reshape(n, -1)[rows, pick] | (room < 0), 0, (pick % letters) << room.clip(0))
        with np.errstate(invalid="ignore"):
            order = np.lexsort((pick % letters, heads, -np.round(p[rows, pick], 9)), axis=1)
        pick, heads = pick[rows, order], heads[rows, order]
        hyp, s = pick // letters, pick % letters
        kept, p = same.reshape(n, -1)[rows, pick], p[rows, pick]
        grown = text[rows, hyp] * symbols + s
        number = np.where(kept, text[rows, hyp], texts.find(grown))
        key = np.where(number >= 0, number, -1 - grown) * symbols + s
        order = np.argsort(key, axis=1, kind="stable")
        ranked = key[rows, order]
        again = np.zeros(key.shape, dtype=bool)
        again[rows, order] = np.pad(ranked[:, 1:] == ranked[:, :-1], ((0, 0), (1, 0)))
        good = ~again & np.isfinite(p)
        place = np.argsort(~good, axis=1, kind="stable")[:, :width]
        live = good[rows, place]
        texts.add(grown[rows, place][live & ~kept[rows, place]])
        text = np.where(live, np.where(kept[rows, place], text[rows, hyp[rows, place]], texts.find(grown[rows, place])), 0)
        head, size = heads[rows, place], size[rows, hyp[rows, place]] + ~kept[rows, place]
        last, state = np.where(live, s[rows, place], 0), np.where(live, to.reshape(n, -1)[rows, pick[rows, place]], 0)
        score = np.where(live, p[rows, place], -np.inf)
    return text, state, score, texts


def readings(logp: np.ndarray, grammar: Grammar, most: int = 5, width: int = 15, alphabet: str = LETTERS):
    """(cell, place, text, conf, whole) of all cells: the best texts that the grammar accepts as a whole, confidences summing to one; if there is none, the best beginning of one with little confidence, none if it is empty."""
    text, state, score, texts = beam_search(logp, grammar, width, alphabet)
    rows = np.arange(len(text))[:, None]
    order = np.argsort(text, axis=1, kind="stable")
    again = np.zeros(text.shape, dtype=bool)
    again[rows, order] = np.pad(text[rows, order][:, 1:] == text[rows, order][:, :-1], ((0, 0), (1, 0)))
    good = grammar.whole[state] & (text > 0) & ~again & np.isfinite(score)
    place = np.argsort(~good, axis=1, kind="stable")[:, :most]
    taken = good[rows, place]
    p = np.where(taken, score[rows, place], -np.inf)
    share = np.exp(p - np.where(taken[:, :1], p[:, :1], 0.0))
    conf = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    none = ~taken[:, 0]
    cell, k = np.nonzero(taken)
    out = [np.concatenate([cell, np.flatnonzero(none)]), np.concatenate([k, np.zeros(none.sum(), dtype=np.int64)])]
    ids = np.concatenate([text[rows, place][taken], text[none, 0]])
    conf = np.concatenate([conf[taken], np.where(text[none, 0] > 0, PARTIAL_CONF, 0.0)])
    return *out, texts.strings(ids, alphabet), conf, np.arange(len(ids)) < len(cell)


def decode(cells: DataFrame, grammar: Grammar, lenient: Grammar | None = None, most: int = 5, width: int = 15, alphabet: str = LETTERS, key: str = "cell") -> DataFrame:
    """(key, kind, place, text, conf) of each of cells(key, frames, symbols, values).

    `strict`: readings() of the grammar, `partial` where it accepts none as a
    whole. `lenient`: readings of the lenient grammar (every text, if none is
    given) that aren't among the strict ones, at half their confidence. The
    cells of a batch that have one shape are decoded together.
    """
    loose = lenient or any_text(alphabet)

    def run(frames):
        for f in frames:
            parts = []
            for who, logp in _by_shape(f, 512):
                names = f[key].to_numpy()[who]
                cell, place, text, conf, whole = readings(logp, grammar, most, width, alphabet)
                strict = pd.DataFrame({key: names[cell], "kind": np.where(whole, "strict", "partial"), "place": place, "text": text, "conf": conf})
                cell, place, text, conf, whole = readings(logp, loose, most, width, alphabet)
                free = pd.DataFrame({key: names[cell], "kind": "lenient", "place": place, "text": text, "conf": conf * LENIENT_SHARE})[whole]
                known = pd.MultiIndex.from_frame(strict.loc[strict["kind"] == "strict", [key, "text"]])
                free = free[~pd.MultiIndex.from_frame(free[[key, "text"]]).isin(known)]
                parts += [strict, free.assign(place=free.groupby(key).cumcount())]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return cells.select(key, "frames", "symbols", "values").mapInPandas(run, f"{key} {dict(cells.dtypes)[key]}, kind string, place int, text string, conf double")


def constrained_rank(scores: DataFrame, key: str = "cell", score: str = "total", most: int = 5, least: float = 0.3) -> DataFrame:
    """(key, text, p, place): softmax of the scores over each key's allowed texts; the best few with enough probability."""
    w = Window.partitionBy(key)
    e = scores.where(F.col(score).isNotNull()).withColumn("e", F.exp(F.col(score) - F.max(score).over(w)))
    e = e.withColumns({"p": F.col("e") / F.sum("e").over(w), "place": F.row_number().over(w.orderBy(F.desc(score), "text"))})
    return e.where((F.col("place") <= most) & (F.col("p") >= least)).select(key, "text", "p", "place")


def fuse(a: DataFrame, b: DataFrame, key: str = "cell", most: int = 5, least: float = 0.3) -> DataFrame:
    """(key, text, p, place) of two rankings (key, text, p): 1.5 times the mean where both have a text, else the sum; at most 1."""
    j = a.select(key, "text", F.col("p").alias("x")).join(b.select(key, "text", F.col("p").alias("y")), [key, "text"], "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    p = F.least(F.when(both, (F.col("x") + F.col("y")) / 2 * 1.5).otherwise(F.coalesce("x", "y")), F.lit(1.0))
    j = j.withColumn("p", p).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "text")))
    return j.where((F.col("place") <= most) & (F.col("p") >= least)).select(key, "text", "p", "place")


def renormalise(scores: DataFrame, key: str = "cell", score: str = "total", order: str = "text") -> DataFrame:
    """(key, text, logp): log-softmax over all rows of each key, so that a text that stands there twice counts twice; each text once, and also without its check or mate sign, unless that is a text of its own (of several such the first in `order` counts)."""
    w = Window.partitionBy(key)
    known = scores.where(F.col(score).isNotNull()).withColumn("top", F.max(score).over(w))
    table = known.select(key, "text", F.col(order).alias("o"), (F.col(score) - F.col("top") - F.log(F.sum(F.exp(F.col(score) - F.col("top"))).over(w))).alias("logp"))
    both = F.array(F.struct(F.col("text"), F.lit(0).alias("bare")), F.struct(F.regexp_replace("text", "[+#]+$", "").alias("text"), F.lit(1).alias("bare")))
    return table.select(key, "o", "logp", F.explode(both).alias("x")).groupBy(key, F.col("x.text").alias("text")).agg(F.min_by("logp", F.struct("x.bare", "o")).alias("logp"))


def components(fixes: DataFrame) -> DataFrame:
    """fixes with components, a map of what each adds to the score.

    Columns: ply, stuck_ply, similarity, reach, completes, low_conf, conf,
    lenient, pattern, root_duplicate, duplicate, ambiguous, absurdity. Reach
    counts 10 a ply up to 50, and one more for each ply beyond five where the fix
    isn't before the stuck ply or ends the game; a fix without reach loses by
    similarity, and 5 for each ply in front of the stuck one up to 30. Of
    config.SCORE_INPUTS those that are columns of fixes count as they are (null as 0).
    """
    c, one = F.col, lambda flag: flag.cast("double")
    none = c("reach") <= 0
    steps = F.lit(0)
    for least, loss in reversed(C.ZERO_REACH):
        steps = F.when(c("similarity") >= least, loss).otherwise(steps)
    values = {
        "similarity": c("similarity"), "conf": c("conf"), "completes": one(c("completes")), "low_conf": one(c("low_conf") & (c("conf") > 0.01)), "ambiguous": one(c("ambiguous")),
        "reach": F.least(c("reach") * 10, F.lit(50)), "reach_more": F.when((c("ply") >= c("stuck_ply")) | c("completes"), F.greatest(c("reach") - 5, F.lit(0))).otherwise(0),
        "lenient": c("lenient"), "pattern": F.least(c("pattern"), F.lit(30)), "duplicate": F.when(c("root_duplicate") & (c("ply") != c("stuck_ply")), 25).when(c("duplicate") | c("root_duplicate"), 15).otherwise(0),
        "zero_reach": F.when(none, steps).otherwise(0), "distance": F.when(none & (c("ply") != c("stuck_ply")), F.least((c("stuck_ply") - c("ply")) * 5, F.lit(30))).otherwise(0),
        "direct": F.when(~none & (c("ply") == c("stuck_ply")), 15).otherwise(0), "absurdity": c("absurdity"),
    }
    values |= {k: F.coalesce(c(k), F.lit(0)) for k in C.SCORE_INPUTS if k in fixes.columns}
    return fixes.withColumn("components", F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double")))))


def weighted(fixes: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, score): components times their weights, summed in each row; a component without a weight counts as it is, so one is left out by weight 0."""
    known = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w)))) if weights else F.lit(None).cast("map<string,double>")
    score = F.aggregate(F.map_entries("components"), F.lit(0.0), lambda total, x: total + x["value"] * F.coalesce(F.try_element_at(known, x["key"]), F.lit(1.0)))
    return fixes.select(*keys, score.alias("score"))


def ranked_fixes(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores with place: the rank of a fix among those of its keys by score, equal scores (to nine digits) sharing one."""
    return scores.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)))))


def rescore(scores: DataFrame, evidence: DataFrame | None, keys: list[str], weight: float, abstain: float) -> DataFrame:
    """scores (keys, score) plus weight * (value - abstain) of evidence(keys, value); where there is no value the term is zero. Without evidence no row changes."""
    if evidence is None:
        return scores
    value = F.coalesce("value", F.lit(abstain)) - F.lit(abstain)
    return scores.join(evidence, keys, "left").withColumn("score", F.col("score") + weight * value).drop("value")


def hits_by_weight(candidates: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(group, weight, n, hits): decisions and correct first places of each group under each weight. candidates(group, decision, text, score, value, correct); equal scores go to the smaller text."""
    tried = candidates.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    place = F.struct(-F.round(F.col("score") + F.col("weight") * F.col("value"), 9), "text")
    first = tried.groupBy("group", "decision", "weight").agg(F.min_by("correct", place).alias("hit"))
    return first.groupBy("group", "weight").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def leave_one_out(hits: DataFrame) -> DataFrame:
    """(group, weight, n, hits): of each group, under the weight that hits most in all others (the smallest of equals)."""
    total = hits.groupBy("weight").agg(F.sum("hits").alias("every"))
    rest = hits.join(F.broadcast(total), "weight")  # a row a weight
    return rest.groupBy("group").agg(F.min_by(F.struct("weight", "n", "hits"), F.struct(F.col("hits") - F.col("every"), "weight")).alias("x")).select("group", "x.*")


def paired(candidates: DataFrame, a: float, b: float) -> DataFrame:
    """One row (decisions, a_hits, b_hits, wins, losses, p): decisions that both weights face; wins are b's alone, and p is the two-sided sign test over the discordant ones."""
    place = lambda w: F.struct(-F.round(F.col("score") + w * F.col("value"), 9), "text")
    d = candidates.groupBy("group", "decision").agg(F.min_by("correct", place(a)).alias("a"), F.min_by("correct", place(b)).alias("b"))
    counts = d.agg(F.count("*").alias("decisions"), F.count_if("a").alias("a_hits"), F.count_if("b").alias("b_hits"), F.count_if(F.expr("b and not a")).alias("wins"), F.count_if(F.expr("a and not b")).alias("losses"))

    @F.pandas_udf("double")
    def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
        out = []
        for n, k in zip(wins + losses, np.minimum(wins, losses)):
            logs = np.cumsum(np.concatenate([[0.0], np.log(n - np.arange(k)) - np.log(np.arange(k) + 1)]))  # log of n over 0..k
            out.append(min(1.0, 2 * float(np.exp(logs - n * np.log(2)).sum())) if n else 1.0)
        return pd.Series(out)

    return counts.withColumn("p", sign_test("wins", "losses"))


#: P(Poisson(1) <= k), k = 0..5
POISSON = tuple(float(x) for x in np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)]))


def bootstrap(hits: DataFrame, a: float, b: float, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """One row (net, low, high): net hits of weight b over a, with the interval of `rounds` resamples of whole groups; a group's Poisson(1) copies come from a hash of its number and the round."""
    net = hits.groupBy("group").agg(F.sum(F.when(F.col("weight") == b, F.col("hits")).when(F.col("weight") == a, -F.col("hits")).otherwise(0)).alias("net"))
    draws = net.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = ((F.col("group") * 7919 + F.col("round") * 104729 + 12345) * 2654435761 % (1 << 32)) / float(1 << 32)
    copies = sum((u >= p).cast("int") for p in POISSON)
    sums = draws.groupBy("round").agg(F.sum(F.col("net") * copies).alias("x"))
    end = (1 - level) / 2
    return sums.agg(F.percentile("x", F.lit(end)).alias("low"), F.percentile("x", F.lit(1 - end)).alias("high")).crossJoin(net.agg(F.sum("net").alias("net")))  # one row each


def pattern_bonus(move: Column, pool: Column) -> Column:
    """0 to 30 for a fix that looks like the readings of a pool (in order): its piece is seen, its square or file or rank, captures, or the move itself."""
    piece, target = (lambda m: F.regexp_extract(m, "^[KQRBN]", 0)), (lambda m: F.regexp_extract(m, "[a-h][1-8]", 0))
    count = lambda test: F.size(F.filter(pool, test))
    targets = F.transform(pool, target)
    own, named, end = target(move), piece(move) != "", (lambda m: F.regexp_replace(m, "[+#]+$", ""))

    def near(t):
        n = F.size(F.filter(targets, lambda x: x == t))
        beside = (F.substring(t, 1, 1) == F.substring(own, 1, 1)) | (F.substring(t, 2, 1) == F.substring(own, 2, 1))
        return F.when((t == "") | (own == ""), 0).when(t == own, F.least(5 * n, F.lit(10))).when(beside, F.least(2 * n, F.lit(6))).otherwise(0)

    squares = F.aggregate(F.array_distinct(targets), F.lit(0), lambda acc, t: acc + near(t))
    same = F.filter(pool, lambda m: end(m) == end(move))
    direct = F.when(F.size(same) == 0, 0).when(F.get(same, F.lit(0)) == move, 15).otherwise(10)
    bonus = F.when(named, F.least(F.lit(20), 10 * count(lambda m: piece(m) == piece(move))) + F.when(count(lambda m: piece(m) != "") >= 0.5 * F.size(pool), 5).otherwise(0)).otherwise(0)
    return F.least(F.lit(30), bonus + squares + F.when(move.contains("x") & (count(lambda m: m.contains("x")) >= 0.3 * F.size(pool)), 5).otherwise(0) + direct)


def boosted(pool: Column, evidence: Column) -> Column:
    """A pool of (move, conf), best first, in which the variant of its top with g in the place of the last a gains conf by outside evidence; re-sorted, and as it was where the top has no a, is sure, or the evidence is weak."""
    top = F.get(pool, F.lit(0))
    variant = F.regexp_replace(top["move"], "a(?=[^a]*$)", "g")
    gain = top["conf"] * (evidence * 0.6)
    kept = F.concat(F.slice(pool, 1, 1), F.filter(F.slice(pool, 2, 1 << 20), lambda x: x["move"] != top["move"]))
    at = F.array_position(F.transform(kept, lambda x: x["move"]), variant)
    raised = lambda conf: F.least(F.lit(0.98), conf + gain)
    new = F.when(at > 0, F.transform(kept, lambda x, i: F.struct(x["move"].alias("move"), F.when(i + 1 == at, raised(x["conf"])).otherwise(x["conf"]).alias("conf")))).otherwise(F.concat(kept, F.array(F.struct(variant.alias("move"), raised(F.lit(0.0)).alias("conf")))))
    placed = F.array_sort(F.transform(new, lambda x, i: F.struct((-F.round(x["conf"], 9)).alias("a"), i.alias("b"), x["move"].alias("move"), x["conf"].alias("conf"))))
    hit = top["move"].contains("a") & (evidence >= 0.4) & (top["conf"] <= 0.9)
    return F.when(hit, F.transform(placed, lambda x: F.struct(x["move"].alias("move"), x["conf"].alias("conf")))).otherwise(kept)
