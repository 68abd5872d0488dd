"""Bitmaps of small sets keep most pairs beyond the limit from being compared, and none within it."""

from __future__ import annotations

import numpy as np

from pricewell.llm import jaccard


def passed(differ: int, tries: int = 2000) -> float:
    """Share of pairs of sets of 40 grams, with so many grams in only one of them, that bitmaps let through."""
    rule, rng, n = jaccard.Rule(5, 80), np.random.default_rng(1), 0
    for _ in range(tries):
        grams = rng.integers(0, 1 << 63, 40 + differ // 2).astype(np.uint64)
        n += jaccard.distance(jaccard.bitmap(np.sort(grams[:40])), jaccard.bitmap(np.sort(grams[differ // 2 :]))) <= rule.difference(80)
    return n / tries


def test_bitmaps_of_small_sets():
    assert passed(8) == 1
    assert passed(12) < 0.08
