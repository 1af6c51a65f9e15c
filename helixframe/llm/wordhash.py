"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of word bytes of UTF-8. The hash of a word is a polynomial in its bytes
modulo 2**64, taken from differences of running sums, so that one pass over the bytes
serves all words; a finishing mix spreads the bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixframe.llm.common import byte_pieces

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser in the manner of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def space_table() -> np.ndarray:
    """True at the bytes of words that stand between characters 0x20 and 0x09 to 0x0D."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


_WORD, _LOWER = space_table(), lower_table()


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): text i has the words bounds[i] to bounds[i + 1]. A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of size words; of fewer words, of the whole sequence."""
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = mixed(rolled + np.uint64(k + 1)) ^ words[k : k + len(rolled)]
    rolled = mixed(rolled)
    found = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            found.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for w in words[lo:hi]:
                one = mixed(one + np.uint64(0x5851F42D4C957F2D)) ^ w
            found.append(mixed(one))
        else:
            found.append(rolled[:0])
    return found


def shingle_sets(column: pa.Array, size: int):
    """The shingle hashes of each text of a column, in order."""
    for _, data, offsets in byte_pieces(column):
        yield from shingles(*hashed_words(data, offsets), size)
