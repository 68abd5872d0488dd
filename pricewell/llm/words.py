"""Vectorised word hashing shared by the word-based operators.

A word is a run of bytes outside ``[\x20\x09-\x0D]``; A-Z fold to a-z. A whole
Arrow batch is one byte buffer, so word boundaries and 64-bit word hashes of all
its texts come from a few numpy passes and no Python work per word. Hashes are
seeded constants: every task of every run gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one numpy pass; a longer single text gets a pass of its own.
PASS_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT_TABLE = _TABLE.copy()
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
for _t in (_TABLE, _EXACT_TABLE):
    _t[_SPACE] = 0
_LINE_TABLE = np.random.Generator(np.random.PCG64(20240301)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(0, np.uint64)
_INVERSES = np.ones(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads differences over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, PASS_BYTES + 1)
        _POWERS = np.full(size, _BASE, np.uint64)
        _INVERSES = np.full(size, _INVERSE, np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        np.cumprod(_POWERS, out=_POWERS)
        np.cumprod(_INVERSES, out=_INVERSES)
    return _POWERS[:n], _INVERSES[:n]


class Words(NamedTuple):
    """Words of consecutive texts; text i has words offsets[i] .. offsets[i+1]."""

    first: int  # row of the batch that text 0 is
    raw: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # byte offsets of the texts in raw
    hashes: np.ndarray  # uint64, one a word
    starts: np.ndarray  # byte offset of each word in raw
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, fold: bool = True) -> Iterator[Words]:
    """Hashes of all words, in runs of rows of about PASS_BYTES. fold: lower-case A-Z."""
    if not len(column):
        return
    raw, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS_BYTES, "right")) - 1)
        bounds = offsets[row : end + 1] - offsets[row]
        part = raw[offsets[row] : offsets[end]]
        yield _hashed(row, part, bounds, _TABLE if fold else _EXACT_TABLE)
        row = end


def _hashed(first: int, raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    n = len(raw)
    space = _SPACE[raw]
    begins = np.ones(n, bool)
    begins[1:] = space[:-1]
    begins[bounds[:-1][bounds[:-1] < n]] = True
    begins &= ~space
    starts = np.flatnonzero(begins)
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return Words(first, raw, bounds, np.zeros(0, np.uint64), starts, offsets)
    powers, inverses = _powers(n)
    hashes = np.add.reduceat(table[raw] * powers, starts) * inverses[starts]
    return Words(first, raw, bounds, mix(hashes), starts, offsets)


def line_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of every line of the texts; lines end at \\n or the text's end, and equal lines have equal hashes."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    breaks = raw == 0x0A
    first[1:] |= breaks
    first = first[:n]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    powers, inverses = _powers(n)
    values = _LINE_TABLE[raw]
    values[breaks] = 0
    return starts, mix(np.add.reduceat(values * powers, starts) * inverses[starts])


def word_ends(w: Words) -> np.ndarray:
    """Byte offset just after each word."""
    inner = ~_SPACE[w.raw]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    edge = w.bounds[1:-1] - 1
    edge = edge[(edge >= 0) & (edge < len(inner))]
    last[edge] = inner[edge]
    return np.flatnonzero(last) + 1


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; the caller drops windows that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
    return mix(out)


def inside(offsets: np.ndarray, total: int, n: int) -> np.ndarray:
    """True for n-word windows, by first word, that stay within one text."""
    keep = np.ones(max(total - n + 1, 0), bool)
    for back in range(1, n):
        at = offsets[1:-1] - back
        at = at[(at >= 0) & (at < len(keep))]
        keep[at] = False
    return keep
