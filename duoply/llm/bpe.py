"""Byte-level BPE compiled, on demand, to deterministic counting transducers.

Two machines run over a text, both as table lookups over many lanes at once:

* The *cutter* splits a text into pre-tokens (the word pattern of byte-level
  BPE files). It has twelve states and eleven character classes. A text is cut
  into fixed chunks; every chunk becomes a map from entry state to exit state,
  the maps are composed by a parallel prefix scan, and each chunk is then run
  once from its true entry state to mark where pre-tokens begin.
* The *counter* reads the bytes of one pre-token. Its state holds, for every
  suffix that could still grow into a longer token, the place in the vocabulary
  trie, the last token in front of that suffix, and how many tokens lie between
  there and here. A transition is annotated with the change in token count.
  States are created when first met; the table is emptied when it is full, so
  memory is bounded and results don't depend on what was seen before.

The counter is exact because a token sequence is the BPE encoding of its text
if and only if BPE keeps every adjacent pair of it as it is, so exactly one
token that ends at a position fits what stands before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, BLANK, NUMBER, OTHER, APOSTROPHE, STMD, R, V, L, E, LETTER, PAD = range(12)
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK, APOS, APOS_R, APOS_V, APOS_L = range(12)
HERE, BEFORE = 32, 64  # a pre-token begins at this character, at the one before
CHUNK, TAIL, SLICE = 128, 6, 1 << 19
#: Words of more bytes are read byte by byte instead of side by side with others.
LONG = 4096
#: Bytes of words that are read between looks at how full the table is.
WORDS = 1 << 15
#: Words up to 15 bytes whose tokens are remembered, and most tokens of such a word.
SLOTS, TOKENS = 1 << 19, 8
#: The pattern of byte-level BPE files which the cutter recognises (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _run_of(c: int) -> int:
    """State of a run that begins with a character of class c, apart from blanks and apostrophes."""
    return WORD if c >= STMD else DIGITS if c == NUMBER else SIGNS


def _step(q: int, c: int) -> int:
    """Next state, with HERE and BEFORE."""
    if c == PAD:
        return q
    blank, run = c <= BLANK, _run_of(c)
    if q == APOS_R and c == E or q == APOS_V and c == E or q == APOS_L and c == L:
        return START
    if q in (APOS_R, APOS_V, APOS_L):  # no contraction: the letter began a word
        return _step(WORD, c) | BEFORE
    if q == APOS:
        if c == STMD:
            return START
        if c in (R, V, L):
            return {R: APOS_R, V: APOS_V, L: APOS_L}[c]
        if c in (OTHER, APOSTROPHE):
            return SIGNS
    if blank:
        if q in (ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK):
            return MANY_SPACE if c == SPACE else MANY_BLANK
        return (ONE_SPACE if c == SPACE else ONE_BLANK) | HERE
    if q == ONE_SPACE:  # this space belongs to what follows
        return run
    if q == MANY_SPACE:
        return run | BEFORE
    if q == MANY_BLANK:
        return _step(START, c) | HERE | BEFORE
    if c == APOSTROPHE:
        return SIGNS if q == SIGNS else APOS | HERE
    return run if q == run else run | HERE


STEP = np.array([[_step(q, c) for c in range(12)] for q in range(12)], dtype=np.uint8)
NEXT = STEP & 31


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point. Where Python's and regex's versions of Unicode differ, the tokenizers library is asked for its own."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    newer = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        newer[[m.start() for m in regex.finditer(pattern, every)]] = kind
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for cp in np.flatnonzero(newer != out).tolist():
        c = every[cp]
        out[cp] = LETTER if len(cut(f"b{c}")) == 1 else NUMBER if len(cut(f"1{c}")) == 1 else OTHER
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[32], out[39] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in letters]] = kind
    return out


def cuts(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. kinds: classes of all characters of texts that follow each other; sizes: characters of each text."""
    per = -(-sizes // CHUNK)
    n = int(per.sum())
    if not n:
        return np.zeros(0, dtype=bool)
    text = np.repeat(np.arange(len(sizes)), per)
    order = np.arange(n) - (np.cumsum(per) - per)[text]
    rest = np.minimum(CHUNK, sizes[text] - order * CHUNK)
    real = (np.arange(CHUNK) < rest[:, None]).ravel()
    lanes = np.full(n * CHUNK, PAD, dtype=np.uint8)
    lanes[real] = kinds
    lanes = np.ascontiguousarray(lanes.reshape(n, CHUNK).T)

    entry = np.zeros(n, dtype=np.uint8)
    if len(more := np.flatnonzero(order + 1 < per[text])):  # chunks that another chunk of the text follows
        ends = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
        maps = ends[more]
        for t in range(CHUNK - TAIL, CHUNK):  # if the map of the last characters is constant, so is the whole map
            maps = NEXT[maps, lanes[t, more][:, None]]
        if len(rest_of := np.flatnonzero((maps != maps[:, :1]).any(axis=1))):
            whole = np.tile(np.arange(12, dtype=np.uint8), (len(rest_of), 1))
            for t in range(CHUNK):
                whole = NEXT[whole, lanes[t, more[rest_of]][:, None]]
            maps[rest_of] = whole
        ends[more] = maps
        step = 1
        while step < per.max():  # prefix scan: the map of chunks i-2*step+1 .. i
            i = np.flatnonzero(order >= step)
            ends[i] = np.take_along_axis(ends[i], ends[i - step], axis=1)
            step *= 2
        entry[more + 1] = ends[more, START]
    moved = np.empty_like(lanes)
    state = entry
    for t in range(CHUNK):
        moved[t] = STEP[state, lanes[t]]
        state = moved[t] & 31
    flags = moved.T.ravel()[real]
    begin = (flags & HERE) > 0
    begin[:-1] |= (flags[1:] & BEFORE) > 0
    ends_at = np.cumsum(rest) - 1
    begin[ends_at[(order + 1 == per[text]) & (state >= APOS_R)]] = True
    return begin


GROUP = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4, 5], dtype=np.uint8)


def quick_cuts(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same as cuts(), by comparing neighbours instead of running the cutter."""
    n = len(kinds)
    if not n:
        return np.zeros(0, dtype=bool)
    ends = np.cumsum(sizes)
    group = GROUP[kinds]
    blank, first = group <= 1, np.zeros(n + 1, dtype=bool)
    first[ends - sizes] = True
    last, first = first[1:].copy(), first[:-1]
    last[-1] = True
    before = np.concatenate([[9], group[:-1]]).astype(np.uint8)
    before[first] = 9
    after_blank = np.concatenate([blank[1:], [True]]) | last
    begin = first | np.where(blank, (before > 1) | ~after_blank, (group != before) & (before != 0))
    if len(mark := np.flatnonzero((kinds == APOSTROPHE) & begin)):
        room = ends[np.searchsorted(ends, mark, side="right")] - mark
        one, two = (np.append(kinds, [PAD] * 2)[mark + i] for i in (1, 2))
        short = (room > 1) & (one == STMD)
        long = (room > 2) & ((one == R) & (two == E) | (one == V) & (two == E) | (one == L) & (two == L))
        begin[mark[short | long] + 1] = False
        for which, size in ((short, 2), (long, 3)):
            begin[mark[which & (room > size)] + size] = True
    return begin


def slices(text: str):
    """A text in pieces of SLICE characters at most, each of which ends where a pre-token ends whatever stands around; a run of one kind that has no such place comes as one longer piece."""
    at = 0
    while len(text) - at > SLICE:
        seen, place = at, 0
        while not place and seen < len(text):
            first = max(at, seen - 1)
            kinds = classes()[np.frombuffer(text[first : seen + SLICE].encode("utf-32-le"), dtype=np.uint32)]
            group = GROUP[kinds]
            safe = np.flatnonzero((group[1:] != group[:-1]) & (group[:-1] > 1) & (kinds[:-1] != APOSTROPHE))
            if len(safe):
                place = first + 1 + int(safe[-1] if seen == at else safe[0])
            seen += SLICE
        yield text[at : (end := place or len(text))]
        at = end
    if at < len(text):
        yield text[at:]


def endless(text: str) -> list[bytes]:
    """Pre-tokens of a piece that slices() could not cut: a few long runs, of which only the ends say where pre-tokens begin."""
    kinds, edges, last = [], [], None
    for i in range(0, len(text), SLICE):
        part = classes()[np.frombuffer(text[i : i + SLICE].encode("utf-32-le"), dtype=np.uint32)]
        new = np.flatnonzero(np.diff(part, prepend=255 if last is None else last))
        edges += (new + i).tolist()
        kinds += part[new].tolist()
        last = part[-1]
    short, place = [], []
    for kind, a, b in zip(kinds, edges, [*edges[1:], len(text)]):
        kept = range(a, b) if b - a <= 8 else [*range(a, a + 4), *range(b - 4, b)]
        short += [kind] * len(kept)
        place += kept
    begin = [place[i] for i in np.flatnonzero(quick_cuts(np.array(short, dtype=np.uint8), np.array([len(short)])))]
    return [text[a:b].encode() for a, b in zip(begin, [*begin[1:], len(text)])]


class Transducer:
    """counts(texts) and ids(texts) as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str, most_states: int = 1 << 17):
        self.path, self.most = path, most_states
        vocab, added, merges = self._file()
        self.special = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        made = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("only files whose ids are in the order of their merges are compiled")
        self.length = np.zeros(max(vocab.values()) + 1, dtype=np.int32)
        self.length[list(vocab.values())] = [len(b) for b in vocab]
        self._library = self.children = None
        self.summed, self.placed = (np.zeros((SLOTS, 2), dtype=np.uint64) for _ in range(2))
        self.words = np.zeros((SLOTS, TOKENS), dtype=np.int32)
        self.sizes, self.many = (np.zeros(SLOTS, dtype=np.uint8) for _ in range(2))

    def _file(self) -> tuple[dict[bytes, int], dict[str, int], list[tuple[bytes, bytes]]]:
        """(ids by bytes, ids of special tokens, pairs that merge, first ones first)."""
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are compiled")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        return vocab, special, [tuple(map(raw, pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]

    def build(self) -> None:
        """The vocabulary trie and the merges, which only the counter needs."""
        vocab, _, merges = self._file()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, tuple[int, int]]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
            self.parts.setdefault(vocab[a + b], (rank, (vocab[a], vocab[b])))
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for b, i in vocab.items():
            if self.bpe(b) != [i]:
                continue  # no text has it
            node = 0
            for x in b:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][x]
            self.ends[node] = i
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.slots(1 << 12)
        self.state(((0, -1, 0),))

    def slots(self, n: int) -> None:
        """An empty table of transitions: keys 256 * state + byte, by open addressing."""
        self.arcs, self.shift = 0, 32 - (n.bit_length() - 1)
        self.keys, self.values = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32)

    def put(self, key: int, value: int) -> None:
        self.arcs += 1
        if 2 * self.arcs > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            pairs = list(zip(self.keys[old].tolist(), self.values[old].tolist()))
            self.slots(2 * len(self.keys))
            for k, v in pairs:
                self.put(k, v)
            self.arcs += 1
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> self.shift
        while self.keys[at] >= 0:
            at = (at + 1) % len(self.keys)
        self.keys[at], self.values[at] = key, value

    def find(self, key: np.ndarray) -> np.ndarray:
        """Transitions (see arc), -1 where there is none yet."""
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> self.shift
        there = self.keys[at]
        value = np.where(there == key, self.values[at], -1)
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] = place = (at[more] + 1) % len(self.keys)
            there = self.keys[place]
            hit = there == key[more]
            value[more[hit]] = self.values[place[hit]]
            more = more[~hit & (there >= 0)]
        return value

    def follow(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of count, of one byte."""
        key = 256 * state + byte
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> self.shift
        while (there := self.keys[at]) != key and there >= 0:
            at = (at + 1) % len(self.keys)
        to, change = divmod(int(self.values[at]) if there == key else self.arc(state, byte), 256)
        return to, change - 128

    def bpe(self, data: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in data]
        while len(ids) > 1:
            rank, i, to = min((*self.merge.get(p, (1 << 30, 0)), k)[::2] + (self.merge.get(p, (0, 0))[1],) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            ids[i : i + 2] = [to]
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the right (1) or left (0) end of a token while BPE builds it, each with the rank of the merge that takes it away."""
        out, gone = [], 1 << 30
        while True:
            out.append((token, gone))
            if token not in self.parts:
                return out
            gone, halves = self.parts[token]
            token = halves[side]

    def fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves a, b as they are: no merge across the border comes before those inside; of equal ranks the left one comes first."""
        if (k := a << 32 | b) not in self.fits:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            for t, side, known in ((a, 1, self.right), (b, 0, self.left)):
                if t not in known:
                    known[t] = self.edge(t, side)
            self.fits[k] = not any((m := self.merge.get((x, y))) and m[0] < gone_x and m[0] <= gone_y for x, gone_x in self.right[a] for y, gone_y in self.left[b])
        return self.fits[k]

    def state(self, key: tuple) -> int:
        if (found := self.known.get(key)) is not None:
            return found
        self.known[key] = n = len(self.states)
        self.states.append(key)
        return n

    def arc(self, state: int, byte: int) -> int:
        """Next state and count, as 256 * state + 128 + change of count."""
        token, before, grown = -1, 0, []
        for node, behind, count in self.states[state]:
            if (child := self.children[node].get(byte)) is None:
                continue
            if token < 0 and (end := self.ends[child]) >= 0 and (behind < 0 or self.fit(behind, end)):
                token, before = end, count
            if self.children[child]:
                grown.append((child, behind, count))
        change = before + 1
        to = self.state((*((c, b, k - change) for c, b, k in grown), (0, token, 0)))
        self.put(256 * state + byte, found := 256 * to + 128 + change)
        return found

    def ready(self) -> None:
        """The machine, with an empty table if that was full."""
        if self.children is None:
            self.build()
        elif len(self.states) > self.most:
            self.clear()

    def walk(self, word: bytes):
        """State and change of count behind each byte of one word, whatever its length."""
        self.ready()
        state = 0
        for byte in word:
            state, change = self.follow(state, byte)
            yield state, change
            if len(self.states) > 2 * self.most:  # only what is read now stays
                here = self.states[state]
                self.clear()
                state = self.state(here)

    def long_count(self, word: bytes) -> int:
        return sum(change for _, change in self.walk(word))

    def long_ids(self, word: bytes) -> np.ndarray:
        """The ids of one word, from the one token that can end at each byte, backwards."""
        ends = np.fromiter((self.states[state][-1][1] for state, _ in self.walk(word)), dtype=np.int32, count=len(word))
        out, at = [], len(word)
        while at:
            out.append(int(ends[at - 1]))
            at -= int(self.length[out[-1]])
        return np.array(out[::-1], dtype=np.uint32)

    def run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[at : at + size]."""
        self.ready()
        total = np.zeros(len(at), dtype=np.int64)
        lane, state, t = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), 0
        while len(lane):
            key = state * 256 + data[at[lane] + t]
            moved = self.find(key)
            if len(lost := np.flatnonzero(moved < 0)):
                keys, back = np.unique(key[lost], return_inverse=True)
                moved[lost] = np.array([self.arc(*divmod(int(k), 256)) for k in keys], dtype=np.int32)[back]
            state = moved.astype(np.int64) >> 8
            total[lane] += (moved & 255) - 128
            t += 1
            if not (more := size[lane] > t).all():
                lane, state = lane[more], state[more]
            if len(lane) < 8 and t > 200:  # a few long words are quicker one by one
                for i, q in zip(lane.tolist(), state.tolist()):
                    for b in data[at[i] + t : at[i] + size[i]].tolist():
                        q, change = self.follow(q, b)
                        total[i] += change
                break
        return total

    def recall(self, keys: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        """(short words, their keys, their slots, which of them are remembered)."""
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        short = np.flatnonzero(size < 16)
        block = np.lib.stride_tricks.sliding_window_view(padded, 16)[at[short]]
        block[np.arange(16) >= size[short][:, None]] = 0
        block[:, 15] = size[short]
        key = block.view(np.uint64)
        mixed = (key[:, 0] ^ (key[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        return short, key, slot, (keys[slot, 0] == key[:, 0]) & (keys[slot, 1] == key[:, 1])

    def sums(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; the transducer reads each word that isn't remembered."""
        total = np.zeros(len(at), dtype=np.int64)
        short, key, slot, hit = self.recall(self.summed, data, at, size)
        total[short[hit]] = self.sizes[slot[hit]]
        miss = np.ones(len(at), dtype=bool)
        miss[short[hit]] = False
        for i in np.flatnonzero(miss & (size > LONG)).tolist():
            total[i] = self.long_count(data[at[i] : at[i] + size[i]].tobytes())
        miss = np.flatnonzero(miss & (size <= LONG))
        behind = np.cumsum(size[miss])
        for some in np.split(miss, np.flatnonzero(np.diff(behind // WORDS)) + 1):  # each makes as many states at most as it has bytes
            total[some] = self.run(data, at[some], size[some])
        new, which = np.unique(slot[~hit], return_index=True)
        which = np.flatnonzero(~hit)[which]
        self.summed[new], self.sizes[new] = key[which], total[short[which]]
        return total

    def place(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The id that begins at each byte, or -1; the library reads each word that isn't remembered."""
        token = np.full(len(data), -1, dtype=np.int32)
        short, key, slot, hit = self.recall(self.placed, data, at, size)

        def put(begin: np.ndarray, words: np.ndarray, many: np.ndarray) -> None:
            for t in range(words.shape[1]):
                if t and not (go := many > t).all():
                    begin, words, many = begin[go], words[go], many[go]
                token[begin] = words[:, t]
                begin = begin + self.length[words[:, t]]

        put(at[short[hit]], self.words[slot[hit]], self.many[slot[hit]])
        raw, read, length = data.tobytes(), self.library._core_bpe.encode_single_piece, self.length
        alone = np.flatnonzero(size >= 16).tolist()
        if len(lost := np.flatnonzero(~hit)):
            _, which, back = np.unique(key[lost].view("V16").ravel(), return_index=True, return_inverse=True)
            which = lost[which]
            found = [read(raw[i : i + n]) for i, n in zip(at[short[which]].tolist(), size[short[which]].tolist())]
            many = np.array([len(x) for x in found])
            few = many <= TOKENS
            words = np.zeros((len(found), TOKENS), dtype=np.int32)
            words[np.arange(TOKENS) < np.where(few, many, 0)[:, None]] = [i for x in found if len(x) <= TOKENS for i in x]
            put(at[short[lost[few[back]]]], words[back[few[back]]], many[back[few[back]]])
            alone += short[lost[~few[back]]].tolist()
            new, pick = np.unique(slot[which[few]], return_index=True)
            pick = np.flatnonzero(few)[pick]
            self.placed[new], self.many[new], self.words[new] = key[which[pick]], many[pick], words[pick]
        for k in alone:
            word = raw[at[k] : at[k] + size[k]]
            ids = read(word) if len(word) <= LONG else self.long_ids(word)
            token[at[k] + np.concatenate([[0], np.cumsum(length[ids])[:-1]]).astype(np.int64)] = ids
        return token

    @property
    def library(self):
        """tiktoken with the tokens and ranks of this file: it reads single words as the file's own library does."""
        if self._library is None:
            import tiktoken

            self._library = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self._file()[0], special_tokens={})
        return self._library

    def _parts(self, texts: list[str | None]):
        """Slices of whole texts between special tokens: (parts, the text of each, specials of each text). A part over the slice size comes alone (see slices)."""
        parts, owner, marks, chars = [], [], [], 0
        for k, x in enumerate(texts):
            x = x or ""
            pieces = self.split.split(x) if self.split and any(s in x for s in self.special) else [x]
            for p in pieces:
                if p in self.special:
                    marks.append((k, len(parts), self.special[p]))
                    continue
                for piece in slices(p):
                    if parts and chars + len(piece) > SLICE:
                        yield parts, owner, marks
                        parts, owner, marks, chars = [], [], [], 0
                    parts.append(piece)
                    owner.append(k)
                    chars += len(piece)
        if parts or marks:
            yield parts, owner, marks

    def _cut(self, parts: list[str], cut):
        whole = "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        chars = np.array([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(whole.encode(), dtype=np.uint8)
        begin = np.flatnonzero(cut(classes()[codes], chars))
        of = np.searchsorted(np.cumsum(chars), begin, side="right")
        if len(data) > len(codes):
            wide = np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))
            begin = np.where(begin > 0, wide[begin - 1], 0)
        return data, begin, np.diff(np.append(begin, len(data))), of

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        for parts, owner, marks in self._parts(texts):
            if parts and len(parts[0]) > SLICE:
                out[owner[0]] += sum(map(self.long_count, endless(parts[0])))
            elif parts:
                data, at, size, of = self._cut(parts, cuts)
                out += np.bincount(np.array(owner)[of], self.sums(data, at, size), len(texts)).astype(np.int64)
            for k, _, _ in marks:
                out[k] += 1
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for parts, owner, marks in self._parts(texts):
            found: list[np.ndarray] = []
            if parts and len(parts[0]) > SLICE:
                found = [np.concatenate([self.long_ids(word) for word in endless(parts[0])])]
            elif parts:
                data, at, size, of = self._cut(parts, quick_cuts)
                token = self.place(data, at, size)
                ends = np.cumsum([len(p.encode()) for p in parts])
                kept = np.flatnonzero(token >= 0)
                found = np.split(token[kept].astype(np.uint32), np.searchsorted(kept, ends[:-1]))
            at_mark = iter([*marks, None])
            mark = next(at_mark)
            for i in range(len(parts) + 1):
                while mark and mark[1] == i:
                    out[mark[0]].append(np.array([mark[2]], dtype=np.uint32))
                    mark = next(at_mark)
                if i < len(parts):
                    out[owner[i]].append(found[i])
        return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint32) for x in out]


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """One per Python worker and file."""
    return Transducer(path)
