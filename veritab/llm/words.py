"""Words of many texts at once: boundaries and 64-bit hashes with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from veritab.llm.common import mix

REACH = 4096  # longer words get a hash of their own
RANDOM = np.random.default_rng(20).integers(1, 2**64, REACH, np.uint64, endpoint=False) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lookup(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


def spans(blank: np.ndarray, starts: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: a run without blanks within one text; ``cut`` marks more begins."""
    n = len(blank)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | edge[1:n] if cut is None else blank[:-1] | edge[1:n] | cut[1:]
    begin = np.flatnonzero(first)
    stop = np.empty(len(begin), np.int64)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    stop[:] = np.flatnonzero(last) + 1
    return begin, stop


def hashes(low: np.ndarray, blank: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    step = np.ones(len(low), np.int32)
    step[begin[1:]] = 1 - np.diff(begin)
    step[: begin[0] + 1] = 0
    place = np.cumsum(step, dtype=np.int32, out=step)
    place &= REACH - 1
    value = RANDOM[place]
    del step, place
    value *= np.add(low, 1, dtype=np.uint64)
    value[blank] = 0
    out = mix(np.add.reduceat(value, begin) + (stop - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in np.flatnonzero(stop - begin > REACH):
        out[k] = xxhash.xxh3_64_intdigest(low[begin[k]: stop[k]].tobytes())
    return out
