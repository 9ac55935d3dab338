"""Choosing groups whose sizes come close to a target, over the histogram of sizes (never a row per group)."""

from __future__ import annotations

import random


def choose(histogram: dict[int, int], target: int, restarts: int = 50, seed: int = 1) -> dict[int, int]:
    """How many groups of each size to take so that their total comes near target without passing it. Each restart takes
    the sizes in another order, as many of each as fit; the first is the largest first. The same for the same input."""
    sizes = sorted((s for s in histogram if s > 0), reverse=True)
    rng = random.Random(seed)
    best: dict[int, int] = {}
    best_left = target
    for _ in range(restarts):
        left, now = target, {}
        for s in sizes:
            n = min(histogram[s], left // s)
            if n:
                now[s] = n
                left -= n * s
        if left < best_left:
            best, best_left = now, left
        if not best_left:
            break
        rng.shuffle(sizes)
    return best
