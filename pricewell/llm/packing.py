"""Operator 2: sum-of-squares online packing into fixed windows of tokens.

Each document's remainder below a full window goes to the fill level that leaves
the smallest sum of squared counts of partially filled windows; a level array
holds those counts. Every task packs the documents of its own input split, so
nothing is shuffled and memory holds one split's open windows at most. When a split ends, its open windows
are emptied into each other with cuts, and what is left is cut into windows
whose fills are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import trimmed
from pricewell.llm.tokens import ByteBpe, forget

WINDOW = 2048
END_ID = 1

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Piece(NamedTuple):
    doc_id: int
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])


class Packer:
    """Places pieces; ``closed`` gets each finished window as a list of pieces."""

    def __init__(self, window: int, closed: Callable[[list[Piece]], None]) -> None:
        self.window, self.closed = window, closed
        self.counts = np.zeros(window + 1, np.int64)  # of open windows, by fill level
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.leave = np.full(window, np.iinfo(np.int64).max // 4)  # change in the sum of squares when a window leaves a level
        self.leave[0] = 0
        self.enter = np.ones(window + 1, np.int64)  # and when one enters it; a full window counts nothing
        self.enter[window] = 0

    def _count(self, level: int, by: int) -> None:
        if 0 < level < self.window:
            n = self.counts[level] = self.counts[level] + by
            self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
            self.enter[level] = 2 * n + 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        rest = Piece(doc_id, 0, ids, len(ids))
        while len(rest.ids) >= self.window:
            piece, rest = rest.cut(self.window)
            self.closed([piece])
        size = len(rest.ids)
        if not size:
            return
        change = self.leave[: self.window - size + 1] + self.enter[size:]
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        pieces = self.open[level].pop() if level else []
        self._count(level, -1)
        pieces.append(rest)
        if level + size == self.window:
            self.closed(pieces)
        else:
            self.open[level + size].append(pieces)
            self._count(level + size, 1)

    def finish(self) -> None:
        """Empties the least filled windows into the most filled ones, then cuts the last one into powers of two."""
        left = [(level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]
        spare: list[Piece] = []
        while left:
            level, pieces = left.pop(0)
            room = self.window - level
            while room and (spare or left):
                if not spare:
                    spare = left.pop()[1]
                piece = spare.pop()
                if len(piece.ids) > room:
                    spare.append(piece.cut(room)[1])
                    piece = piece.cut(room)[0]
                pieces.append(piece)
                room -= len(piece.ids)
            if room:
                self._powers(pieces)
            else:
                self.closed(pieces)
        if spare:
            self._powers(spare)

    def _powers(self, pieces: list[Piece]) -> None:
        total = sum(len(p.ids) for p in pieces)
        queue = pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            room, own = total & (1 << bit), []
            while room:
                piece = queue.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    queue.append(rest)
                own.append(piece)
                room -= len(piece.ids)
            if own:
                self.closed(own)


def _rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
    pieces = [p for _, w in windows for p in w]
    sizes = np.array([len(p.ids) for p in pieces], np.int64)
    fills = [sum(len(p.ids) for p in w) for _, w in windows]
    per = [len(w) for _, w in windows]
    offset = np.cumsum(sizes) - sizes - np.repeat(np.cumsum(fills) - fills, per)
    return pa.record_batch(
        {
            "doc_id": pa.array([p.doc_id for p in pieces], pa.int64()),
            "start": pa.array([p.start for p in pieces], pa.int64()),
            "length": pa.array(sizes),
            "ids": pa.array([p.ids.astype("<u4").tobytes() for p in pieces], pa.binary()),
            "doc_tokens": pa.array([p.doc_tokens for p in pieces], pa.int64()),
            "sequence_id": pa.array(np.repeat(np.array([i for i, _ in windows], np.int64), per)),
            "offset": pa.array(offset),
            "sequence_tokens": pa.array(np.repeat(np.array(fills, np.int64), per)),
        }
    )


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs every document's ids, then end_id, into windows: one row a piece.

    docs: doc_id long, text string; other columns are ignored. vocabulary: a
    tiktoken file of byte-level BPE ranks. A null text counts as empty, so its
    document is the end id alone; an empty table gives no rows; equal rows are
    packed each. A null doc_id stays null. ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit numbers. A window's fill is ``window`` or a
    power of two. Sequence ids are unique over the run: the input split's number
    times 2^33, plus a count.
    """

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        tokens, done = ByteBpe(vocabulary), []

        def closed(pieces: list[Piece]) -> None:
            nonlocal sequence
            done.append((sequence, pieces))
            sequence += 1

        packer, last = Packer(window, closed), np.array([end_id], np.uint16)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in tokens.texts(batch.column(1)):
                for i in range(len(bounds) - 1):
                    packer.add(doc_ids[first + i], np.concatenate([ids[bounds[i] : bounds[i + 1]], last]))
                if len(done) >= 512:
                    yield _rows(done)
                    done.clear()
        packer.finish()
        if done:
            yield _rows(done)
        forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, SCHEMA)
