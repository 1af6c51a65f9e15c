"""Recompression of a sequence of numbers into a run-length grammar, and longest common extensions read from it.

Two steps alternate. Block compression makes a symbol of each maximal block of one symbol,
by symbol and length. Pair compression splits the symbols into left and right ones by a keyed
bit and makes a symbol of each left one with a right one behind it. Equal symbols of a level
stand for equal stretches, and equal stretches are cut alike but for a symbol at each end;
so an extension is found by climbing while what stands next is equal and both places are at
edges of the next level, and by going down from where they differ: one step a level. All
queries climb side by side in numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from helixframe.llm.wordhash import mixed


@dataclass
class Level:
    """A level and how it is made into the next one. Places are edges: edge e has e symbols before it."""

    symbols: np.ndarray  #: with a value of its own before the first and behind the last symbol
    block: bool  #: whether blocks or pairs make the next level
    first: np.ndarray  #: the edge here of each edge of the next level, and once more the last
    up: np.ndarray  #: of each edge here, how many edges of the next level lie before it
    edge: np.ndarray  #: whether an edge here is one of the next level

    def step(self, a: np.ndarray, b: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges a and b moved over a symbol that stands next to both, or over what both have left of a block of it; and whether neither block has more."""
        same = self.symbols[a + 1 - back] == self.symbols[b + 1 - back]
        if not self.block:
            return a + np.where(back, -1, 1) * same, b + np.where(back, -1, 1) * same, same
        rest = lambda e: e - self.first[self.up[e] - 1] if back else self.first[self.up[e] + self.edge[e]] - e
        left_a, left_b = rest(a), rest(b)
        moved = np.where(back, -1, 1) * np.where(same, np.minimum(left_a, left_b), 0)
        return a + moved, b + moved, same & (left_a == left_b)


def _level(symbols: np.ndarray, starts: np.ndarray, block: bool) -> Level:
    n, edge = len(symbols), np.append(starts, True)
    first = np.concatenate([np.flatnonzero(starts), [n, n]])
    return Level(np.concatenate([[-2], symbols, [-1]]).astype(np.int32), block, first, np.cumsum(edge) - edge, edge)


class Grammar:
    """The levels of a sequence up to the one where no symbol stands twice, as no two places of that are alike."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        now = pd.factorize(symbols)[0].astype(np.int64)
        turn = 0
        while len(now) > (distinct := int(now.max(initial=-1)) + 1):
            if turn % 2 == 0:
                starts = np.append(True, now[1:] != now[:-1])
                at = np.flatnonzero(starts)
                sizes = np.diff(np.append(at, len(now)))
                made = now[at] * (int(sizes.max()) + 1) + sizes
            else:
                left = (mixed(now.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
                pairs, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
                pairs = other if other.sum() > pairs.sum() else pairs
                starts = np.append(True, ~pairs)
                at = np.flatnonzero(starts)
                two = np.append(pairs, False)[at]
                made = now[at] + np.where(two, (now[np.minimum(at + 1, len(now) - 1)] + 1) * distinct, 0)
            if len(at) < len(now):
                self.levels.append(_level(now, starts, turn % 2 == 0))
                now = pd.factorize(made)[0].astype(np.int64)
            turn += 1

    def extensions(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """For each pair of different places, how many symbols from there on are equal; with back, how many before them."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        height = np.full(len(a), len(self.levels))
        climbing = np.arange(len(a))
        for h, level in enumerate(self.levels):
            one, two = a[climbing], b[climbing]
            go = level.symbols[one + 1 - back] == level.symbols[two + 1 - back]
            inside = np.flatnonzero(go & ~(level.edge[one] & level.edge[two]))
            one[inside], two[inside], go[inside] = level.step(one[inside], two[inside], back)
            height[climbing[~go]] = h
            a[climbing], b[climbing] = np.where(go, level.up[one], one), np.where(go, level.up[two], two)
            climbing = climbing[go]
        for h in range(len(self.levels) - 1, -1, -1):
            level, some = self.levels[h], np.flatnonzero(height > h)
            a[some], b[some], _ = level.step(level.first[a[some]], level.first[b[some]], back)
        return np.abs(a - i)
