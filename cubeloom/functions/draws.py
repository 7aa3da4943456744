"""Exact draws without replacement from counts, without a step per read."""

from __future__ import annotations

import numpy as np

#: NumPy's hypergeometric draws take up to so many of a kind.
LIMIT = 10**9


def _by_inversion(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A hypergeometric draw by inversion over a window of 40 deviations about the mode.

    Ratios of neighbouring probabilities are exact products, added up as logarithms from the mode;
    what lies outside the window is less than the last bit of a float.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = 40 * int(np.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1))) + 1)
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """How many of *good* are among *drawn* of *good* and *bad*, elementwise; counts may be of any size of 64 bits."""
    out = np.zeros(len(good), np.int64)
    small = (good < limit) & (bad < limit)
    out[small] = rng.hypergeometric(good[small], bad[small], drawn[small])
    for i in np.flatnonzero(~small):
        g, b, n = int(good[i]), int(bad[i]), int(drawn[i])
        out[i] = n if b == 0 else 0 if g == 0 or n == 0 else _by_inversion(rng, g, b, n)
    return out


def split(rng: np.random.Generator, counts: np.ndarray, depth: int, limit: int = LIMIT) -> np.ndarray:
    """*depth* of ``sum(counts)`` reads drawn without replacement, by kind: a tree of halves, one draw per inner node.

    All are drawn where there are no more than *depth*.
    """
    levels = [np.asarray(counts, np.int64)]
    while len(levels[-1]) > 1:
        level = levels[-1]
        if len(level) % 2:
            levels[-1] = level = np.append(level, 0)
        levels.append(level[0::2] + level[1::2])
    taken = np.minimum(levels[-1], max(depth, 0))
    for level in reversed(levels[:-1]):
        left = hypergeometric(rng, level[0::2], level[1::2], taken[: len(level) // 2], limit)
        taken = np.column_stack([left, taken[: len(left)] - left]).ravel()
    return taken[: len(counts)]
