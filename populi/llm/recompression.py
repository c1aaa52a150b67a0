"""Run-length grammars of integer sequences by recompression, and longest common extensions read off them.

A sequence is rewritten level by level, by turns: block compression writes every maximal block of one symbol as one
symbol, pair compression writes every pair of a left and a right symbol as one, where a hash of the symbol says which
side it is on. What is written depends on the symbols alone, so equal stretches are written alike but for their edges,
and two positions are compared by climbing while their symbols agree and descending once they differ: one step a level.

Many sequences share one grammar: each is followed by a separator that occurs once and is never written into another
symbol, so no extension leaves its sequence. All work is done on whole levels and whole lists of queries by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class Level:
    symbols: np.ndarray
    block: bool = False  # how the next level was made: block or pair compression
    parent: np.ndarray | None = None  # place in the next level
    first: np.ndarray | None = None  # place in this level of the first symbol of each symbol of the next

    def edges(self, forward: bool) -> np.ndarray:
        """Whether a place starts (or ends) a symbol of the next level."""
        step = np.diff(self.parent) != 0
        return np.concatenate(([True], step)) if forward else np.concatenate((step, [True]))

    def last(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.symbols)) - 1


def _side(symbols: np.ndarray, level: int) -> np.ndarray:
    """A bit of each symbol, new in each level."""
    x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


class Grammar:
    """text: symbols of all sequences; at `separators` stands a symbol that occurs nowhere else."""

    def __init__(self, text: np.ndarray, separators: np.ndarray):
        symbols = pd.factorize(text)[0].astype(np.int64)
        apart = np.zeros(len(text), bool)
        apart[separators] = True
        self.levels = [Level(symbols)]
        idle, turn = 0, 0
        while idle < 2 and len(symbols) > 1:
            block = turn % 2 == 0
            if block:
                starts = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            else:
                left = _side(symbols, turn) & ~apart
                right = ~_side(symbols, turn) & ~apart
                starts = np.concatenate(([True], ~(left[:-1] & right[1:])))
            turn += 1
            if starts.all():
                # a level that changes nothing is left out; pairs get another chance while two symbols can still meet
                meet = bool((~apart[1:] & ~apart[:-1]).any())
                idle = 0 if meet else idle + 1
                continue
            idle = 0
            first = np.flatnonzero(starts)
            below = self.levels[-1]
            below.block, below.first, below.parent = block, first, np.cumsum(starts) - 1
            width = np.diff(np.append(first, len(symbols)))
            if block:
                made = symbols[first] * (int(width.max()) + 1) + width
            else:
                tail = np.where(width == 2, symbols[np.minimum(first + 1, len(symbols) - 1)] + 1, 0)
                made = symbols[first] * (int(symbols.max()) + 2) + tail
            symbols, apart = pd.factorize(made)[0].astype(np.int64), apart[first]
            self.levels.append(Level(symbols))

    def extension(self, x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from x and y on agree (backward: before and including them); x and y differ and neither leaves its sequence."""
        d = 1 if forward else -1
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries whose symbols differ at each level, with their places
        at, u, v = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
        for level in self.levels[:-1]:
            s = level.symbols
            edge = level.edges(forward)
            inside = ~(edge[u] & edge[v])
            differ = inside & (s[u] != s[v])
            step = inside & ~differ
            if level.block:
                far = level.last() if forward else level.first
                room_u, room_v = (far[level.parent[u]] - u) * d + 1, (far[level.parent[v]] - v) * d + 1
                move = np.where(step, np.minimum(room_u, room_v), 0) * d
                differ |= step & (room_u != room_v)
            else:
                move = step * d
            u, v = u + move, v + move
            met.append((at[differ], u[differ], v[differ]))
            at, u, v = at[~differ], level.parent[u[~differ]], level.parent[v[~differ]]
        for level, (more, mu, mv) in zip(self.levels[-2::-1], met[::-1]):
            edge = level.first if forward else level.last()
            u, v = edge[u], edge[v]
            same = level.symbols[u] == level.symbols[v]
            if level.block:
                far = level.last() if forward else level.first
                move = np.where(same, np.minimum((far[level.parent[u]] - u) * d, (far[level.parent[v]] - v) * d) + 1, 0) * d
            else:
                move = same * d
            at, u, v = np.concatenate((at, more)), np.concatenate((u + move, mu)), np.concatenate((v + move, mv))
        out = np.empty(len(x), np.int64)
        out[at] = (u - x[at]) * d
        return out
