"""Words of many texts as arrays of 64-bit hashes, found without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: Bytes that stand between words.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of h moves all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of what h stands for, followed by a word."""
    return mixed(h * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(1))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of whole texts: (hash of each lower-cased word, index of its text). A text over the slice size is cut between words, so only a single word can be longer than a slice."""
    held, owner, size = [], [], 0
    for k, x in enumerate(texts):
        data, at, end = (x or "").lower().encode(), 0, -1
        while end < len(data):
            end = len(data)
            if end - at > SLICE:
                blank = np.flatnonzero(BLANK[np.frombuffer(data, dtype=np.uint8, count=SLICE, offset=at)])
                end = at + int(blank[-1]) + 1 if len(blank) else next((i + 1 for i in range(at + SLICE, end) if BLANK[data[i]]), end)
            held.append(data[at:end])
            owner.append(k)
            size += end - at + 1
            at = end
            if size >= SLICE:
                yield _slice(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _slice(held, owner)


def _slice(held: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(BLANK[data], prepend=True))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    h = (total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))) * down[start] if len(start) else np.zeros(0, dtype=np.uint64)
    text = np.array(owner)[np.searchsorted(np.cumsum([len(b) + 1 for b in held]), start, side="right")]
    return mixed(h), text
