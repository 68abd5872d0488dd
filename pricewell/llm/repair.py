"""Operator 12: cheapest repair of a conversation's structure, by Dijkstra on the edit lattice.

A lattice node is (turn index, grammar state): how many of the turns are behind,
and what the repaired turns so far are in the grammar ``(s?(ua)+)?`` over role
initials. Nodes are made as they are reached. The queue's key is (cost, audit),
audit being the edits' initials, so the first accepting end node popped is the
cheapest repair and of equal ones the ASCII-least.

Turns stream through a task in order. A conversation of up to ``STRETCH`` turns
is one search. A longer one is searched stretch by stretch: the labels of all
states at a stretch's end are the sources of the next one, and what all their
audits agree on is decided, hashed and forgotten. Equal-cost audits of one node
are never prefixes of each other (they differ by pairs of inserts, which cost),
so a node's least label stays least whatever follows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a truncated turn adds unless it is deleted.
TRUNCATED_COST = 3
#: Turns that one search covers.
STRETCH = 1024
#: What any state can do, any other can for at most so much more: insert a turn, and delete a system turn that can't be kept there.
SPREAD = COST[INSERT] + COST[DELETE]
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
OPEN, SYSTEM, USER, ASSISTANT = range(4)
#: Grammar state: the role that a turn may be given there, and where it leads.
NEXT = {OPEN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (OPEN, ASSISTANT)
SPACES = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """The turns as an unreliable export leaves them: some dropped (``gone``), emptied, without sentence ends, repeated, or given to the user, by crc32 of ``conv_id:turn``; nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def _fault(text: Column) -> Column:
    body = F.rtrim(text, F.lit(SPACES))
    return F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


def ordered(turns: DataFrame) -> DataFrame:
    """turns with fault, each conversation whole and in order inside one partition.

    A text that its conversation has at an earlier turn is marked as a duplicate
    by the first turn of each text, counted before the shuffle; equal rows of one
    turn stand side by side, so the search marks those.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = turns.withColumns({"_conv": conv, "_text": F.sha2(F.col("text").cast("binary"), 256), "_kind": F.when(F.col("gone"), -1).otherwise(_fault(F.col("text")))})
    first = rows.where("not gone").groupBy("_conv", "role", "_text").agg(F.min(F.struct("turn")).alias("_first"))
    rows = rows.join(first, ["_conv", "role", "_text"], "left")
    later = ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when(F.col("_kind").isin(TRUNCATED, SOUND) & later, DUPLICATE).otherwise(F.col("_kind"))
    rows = rows.select("_conv", "conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))
    return rows.repartition("_conv").sortWithinPartitions("_conv", "turn", "role", "text").drop("_conv")


class Search:
    """One conversation's repair; turns come one by one, and ``end`` gives the result."""

    def __init__(self, stretch: int = STRETCH) -> None:
        self.stretch = stretch
        self.rows: list[tuple[str, str, int]] = []  # undecided turns: role, text, fault
        self.labels = {OPEN: (0, "")}  # best (cost, audit since what is decided) of each state behind the first ``seen`` undecided turns
        self.seen = 0
        self.state, self.audit, self.hash, self.lines = OPEN, [], hashlib.sha256(), 0

    def add(self, role: str, text: str, fault: int) -> None:
        if len(self.rows) - self.seen == self.stretch:
            self.labels = self._searched(final=False)
            self.seen = len(self.rows)
            self._decide(os.path.commonprefix([audit for _, audit in self.labels.values()]))
        self.rows.append((role, text, fault))

    def end(self) -> tuple[int, str, str]:
        """cost, audit, digest of the repaired turns."""
        ((cost, audit),) = self._searched(final=True).values()
        self._decide(audit)
        return cost, "".join(self.audit), self.hash.hexdigest()

    def _searched(self, final: bool) -> dict[int, tuple[int, str]]:
        """The least label of each state at the end of the turns that can still win; if final, the first accepting one alone."""
        end, found, settled, most = len(self.rows), {}, set(), float("inf")
        queue = [(cost, audit, self.seen, state) for state, (cost, audit) in self.labels.items()]
        heapq.heapify(queue)
        while queue:
            cost, audit, i, state = heapq.heappop(queue)
            if cost > most:
                break
            if (i, state) in settled:
                continue
            settled.add((i, state))
            if i == end:
                if final and state in ACCEPTING:
                    return {state: (cost, audit)}
                found[state] = (cost, audit)
                most = most if final else min(most, cost + SPREAD)
            role, after = NEXT[state]
            steps = [(COST[INSERT], INSERT, i, after)]
            if i < end:
                own, _, fault = self.rows[i]
                steps.append((COST[DELETE], DELETE, i + 1, state))
                if fault > DUPLICATE:
                    more = TRUNCATED_COST if fault == TRUNCATED else 0
                    steps.append((COST[REROLE] + more, REROLE, i + 1, after))
                    if own[:1] == role[0]:
                        steps.append((COST[KEEP] + more, KEEP, i + 1, after))
                    elif own[:1] == "s" and state == OPEN:
                        steps.append((COST[KEEP] + more, KEEP, i + 1, SYSTEM))
            for more, edit, j, to in steps:
                if (j, to) not in settled:
                    heapq.heappush(queue, (cost + more, audit + edit, j, to))
        return found

    def _decide(self, edits: str) -> None:
        """Applies edits to the turns that they cover, and takes them off the labels' audits."""
        done = 0
        for edit in edits:
            role, text, _ = self.rows[done] if edit != INSERT else ("", "", SOUND)
            done += edit != INSERT
            if edit == DELETE:
                continue
            given, after = NEXT[self.state]
            if edit == KEEP and role[:1] == "s":
                after = SYSTEM
            self.hash.update((("\n" if self.lines else "") + f"{role if edit == KEEP else given}:{text}").encode())
            self.state, self.lines = after, self.lines + 1
        self.audit.append(edits)
        self.rows, self.seen = self.rows[done:], self.seen - done
        self.labels = {s: (c, a[len(edits) :]) for s, (c, a) in self.labels.items()}


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class _Report:
    """Counts over one conversation's turns, beside the search."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.search = conv_id, Search()
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        now = (turn, role, text)
        if fault > DUPLICATE and now == self.before:
            fault = DUPLICATE
        if self.before and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:  # in order
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.before = now
        self.faults[fault] += 1
        self.search.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[:3], self.illegal, *self.search.end())


def repaired(turns: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation: one row a conv_id.

    turns: conv_id, turn long, role, text string, gone boolean; other columns are
    ignored. Rows marked gone only vouch for their conversation. Turns are taken
    by turn, nulls first, then by role and text. A blank turn has no character but
    spaces; a duplicate has the role and text of an earlier one; a truncated one
    doesn't end in ``.``, ``!`` or ``?``; a turn counts by its first fault. Edits:
    keep, change the role, delete (which blank and duplicate turns need), insert an
    empty turn. A null conv_id is a conversation of its own; a null role or text
    is one space; a conversation without turns has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows. Memory of a task: ``STRETCH``
    turns, and those on which the labels' audits differ.
    """
    space = F.lit(" ")
    clean = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "gone")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, done = None, []
        for batch in batches:
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if report is None or conv != report.conv_id:
                    if report:
                        done.append(report.row())
                    report = _Report(conv)
                if fault >= 0:
                    report.add(turn, role, text, fault)
            if len(done) >= 4096:
                yield _batch(done)
                done = []
        if report:
            done.append(report.row())
        if done:
            yield _batch(done)

    return ordered(clean).mapInArrow(task, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)
