"""Probing of operator 9's filter: the head's words once, the others block by block."""

from __future__ import annotations

import numpy as np
import pytest

from pricewell.llm import lm

RNG = np.random.default_rng(7)


def made(blocks: int, keys: np.ndarray, levels: np.ndarray) -> lm.Filter:
    flags = np.zeros(blocks * lm.BLOCK_BITS, bool)
    own = lm.Filter(np.zeros(0, np.uint8), blocks).block(keys) * np.uint64(lm.BLOCK_BITS)
    for level in range(1, int(levels.max()) + 1):
        held = levels >= level
        h = lm._spread(keys[held], level)
        for _ in range(lm.HASHES):
            flags[own[held] + (h & np.uint64(lm.BLOCK_BITS - 1))] = True
            h = h >> np.uint64(16)
    return lm.Filter(np.packbits(flags, bitorder="little"), blocks)


def level(bloom: lm.Filter, key: int) -> int:
    """One key, bit by bit."""
    key = np.array([key], np.uint64)
    base = int(bloom.block(key)[0]) * lm.BLOCK_BITS
    for n in range(1, lm.LEVELS + 1):
        h = int(lm._spread(key, n)[0])
        for i in range(lm.HASHES):
            at = base + (h >> 16 * i & lm.BLOCK_BITS - 1)
            if not bloom.bits[at >> 3] >> (at & 7) & 1:
                return n - 1
    return lm.LEVELS


@pytest.mark.parametrize("size", [0, 1, 3000])
def test_levels_equal_probing_key_by_key(size):
    held = RNG.integers(0, 1 << 63, 3000, dtype=np.uint64)
    bloom = made(lm.GROUPS, held, RNG.integers(2, 30, len(held)))
    keys = np.concatenate([held[:size], RNG.integers(0, 1 << 63, size, dtype=np.uint64), held[:size]])
    assert bloom.levels(keys).tolist() == [level(bloom, int(k)) for k in keys]


def test_words_of_the_head_are_not_probed_again():
    head = np.sort(RNG.integers(0, 1 << 63, 500, dtype=np.uint64))
    bloom = made(lm.GROUPS, head, RNG.integers(2, 30, len(head)))
    asked = []

    class Watched(lm.Filter):
        def levels(self, keys):
            asked.extend(keys.tolist())
            return super().levels(keys)

    keys = np.concatenate([head[::3], RNG.integers(0, 1 << 63, 50, dtype=np.uint64)])
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    found = lm.word_levels(Watched(*bloom), keys, head[at] == keys, at, bloom.levels(head).astype(np.uint8))
    assert found.tolist() == bloom.levels(keys).tolist()
    assert sorted(asked) == sorted(set(keys.tolist()) - set(head.tolist()))
