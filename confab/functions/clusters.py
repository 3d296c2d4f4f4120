"""Centres of vectors and the nearest of them, on the driver over a bounded sample or inside a task."""

from __future__ import annotations

import numpy as np

ROUNDS = 8


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds; empty ones move to random rows."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(count)
        first = np.searchsorted(own[order], filled)
        c[filled] = np.add.reduceat(x[order], first, axis=0) / count[filled][:, None]
        empty = np.flatnonzero(count == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c
