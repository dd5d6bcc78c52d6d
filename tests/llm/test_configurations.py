"""The configuration program itself: its gap, its rounding, and how little is left to best fit."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from corpusveil.llm import packing


def test_the_program_places_most_pieces(monkeypatch):
    rng = random.Random(1)
    need = np.zeros(257, dtype=np.int64)
    for _ in range(20_000):
        need[min(255, 1 + int(rng.expovariate(1 / 70)))] += 1
    uses, bound = packing.fractional(need, 256)
    cover = np.zeros(257)
    for config, x in uses.items():
        assert sum(config) <= 256 and x > 0
        np.add.at(cover, list(config), x)
    assert (cover >= need * (1 - 1e-9)).all()
    assert bound <= sum(uses.values()) <= 1.1 * bound
    whole, left = packing.rounded(uses, need)
    held = Counter()
    for config, n in whole.items():
        assert config in uses
        for x in config:
            held[x] += n
    assert all(held[x] + left[x] == need[x] for x in range(257)) and left.min() >= 0 and left.sum() <= 0.2 * need.sum()
    seen = []
    monkeypatch.setattr(packing, "best_fit", lambda rest, capacity, f=packing.best_fit: seen.append(rest) or f(rest, capacity))
    plan, least = packing.solve({int(x): int(need[x]) for x in np.flatnonzero(need)}, 256)
    assert seen == [{int(x): int(left[x]) for x in np.flatnonzero(left)}]
    assert least <= sum(n for _, n in plan) <= 1.01 * least
