"""Medians over sliding windows of days, exact, without a shuffled row for each day that sees an observation.

Observations meet in blocks of ``BLOCK`` days of a cell, each once for every block
whose windows reach it, so a shuffle carries little more than the observations. A
task takes whole blocks in chunks and lays windows of like size out as the rows of
a table. What it holds follows the prices of one cell in a block, whatever the
length of the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 28
#: Rows of whole blocks that are taken together, and numbers in a table of windows.
CHUNK, SLAB = 1 << 15, 1 << 20


def blocks(rows: DataFrame, back: int) -> DataFrame:
    """rows with observed_on as day number ``_day``, once for each ``_block`` that sees it on its own day or up to ``back`` days later. Rows without a day are left out."""
    day = F.unix_date("observed_on")
    block = lambda d: F.floor(d / BLOCK).cast("int")
    return rows.where("observed_on is not null").select("*", day.alias("_day"), F.explode(F.sequence(block(day), block(day + back))).alias("_block"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def by_block(rows: DataFrame, keys: list[str], back: int, made: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """made: whole blocks, and the number of each row's block among them -> result."""
    keys, chunk = [*keys, "_block"], CHUNK

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.any([np.diff(_codes(t.column(c))) != 0 for c in keys], axis=0)
            end = len(t) if last else int(np.max(np.flatnonzero(new), initial=-1)) + 1
            held[:] = t.slice(end).to_batches()
            if end:
                yield from made(t.slice(0, end), np.concatenate([[0], np.cumsum(new[: end - 1])]))

        wait = chunk
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= wait:
                yield from ready(False)
                wait = chunk + 2 * sum(b.num_rows for b in held)  # a large block isn't looked through for each batch
        if held:
            yield from ready(True)

    return blocks(rows, back).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


class Slab(NamedTuple):
    """Windows of like size, one a row: those who see the rows ``at`` (beyond ``n`` of them the last one again), from row ``first`` of the chunk's windows on."""

    window: np.ndarray
    n: np.ndarray
    at: np.ndarray
    inside: np.ndarray


class Windows(NamedTuple):
    block: np.ndarray  # of each window: its number
    on: np.ndarray  # its day
    row: np.ndarray  # one of its rows
    entry: np.ndarray  # rows of all windows, window by window
    start: np.ndarray
    n: np.ndarray

    def slabs(self) -> Iterator[Slab]:
        size = np.ceil(np.log2(self.n)).astype(int)
        for s in np.unique(size):
            of_size = np.flatnonzero(size == s)
            step = max(1, SLAB >> int(s))
            for i in range(0, len(of_size), step):
                w = of_size[i : i + step]
                n = self.n[w]
                place = np.arange(int(n.max()))
                inside = place < n[:, None]
                yield Slab(w, n, self.entry[self.start[w][:, None] + np.minimum(place, n[:, None] - 1)], inside)


def windows(block: np.ndarray, first: np.ndarray, day: np.ndarray, order: np.ndarray, start: int, back: int) -> Windows:
    """All windows of a chunk: the day less ``back`` to the day less ``start``. first: the first day of each row's block; order: the rows, in the order that windows keep."""
    entry = np.tile(order, back - start + 1)
    on = day[entry] + np.repeat(np.arange(start, back + 1), len(order)) - first[entry]
    keep = (on >= 0) & (on < BLOCK)
    entry, on = entry[keep], on[keep]
    key = block[entry] * BLOCK + on
    place = np.empty(len(block), np.int64)
    place[order] = np.arange(len(order))
    ranked = np.argsort(key * np.int64(len(block) + 1) + place[entry])
    entry, key = entry[ranked], key[ranked]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return Windows(key[starts] // BLOCK, first[entry[starts]] + key[starts] % BLOCK, entry[starts], entry, starts, np.diff(np.append(starts, len(key))))


def days_of(number: np.ndarray) -> pa.Array:
    return pa.array(number.astype(np.int32)).cast(pa.date32())


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def weighted_median(values: np.ndarray, weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A window a row, of ``n`` ascending values and then weights of 0: the first value whose cumulative weight passes half; at half exactly the middle of it and the next."""
    running, place = np.cumsum(weights, axis=1), np.arange(values.shape[1])
    half = running[:, -1:] / 2.0
    inside = place < n[:, None]
    even = (np.abs(running - half) <= 1e-12) & inside
    over = (running > half) & inside & ~even
    every = np.arange(len(values))
    found = np.where(over.any(axis=1), values[every, np.argmax(over, axis=1)], np.inf)
    at = np.argmax(even, axis=1)  # of several the first, as values ascend
    middle = (values[every, at] + values[every, np.minimum(at + 1, n - 1)]) / 2.0
    return np.where(even.any(axis=1), np.minimum(found, middle), found)


def weighted_medians(rows: DataFrame, back: int, half_life: float, lowest: int = 0) -> DataFrame:
    """location_id, item, as_of, n, value: weighted medians of the days from as_of - back to as_of; lowest: the ``lowest`` smallest prices of each window.

    rows: location_id, item, observed_on, unit_price and factor, both above 0. A
    weight is the factor, halved every ``half_life`` days.
    """
    recency = np.array([math.pow(2.0, -age / half_life) for age in range(back + 1)])

    def made(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        price, factor, day = (numbers(t, c) for c in ("unit_price", "factor", "_day"))
        found = windows(block, numbers(t, "_block") * BLOCK, day, np.lexsort((price, block)), 0, back)
        value, low = np.zeros(len(found.n)), [None] * len(found.n)
        for s in found.slabs():
            p = price[s.at]
            value[s.window] = weighted_median(p, np.where(s.inside, recency[np.clip(found.on[s.window][:, None] - day[s.at], 0, back)] * factor[s.at], 0.0), s.n)
            if lowest:
                for w, n, v in zip(s.window, s.n, p[:, :lowest], strict=True):
                    low[w] = v[:n]
        cells = t.select(["location_id", "item"]).take(pa.array(found.row))
        columns = [*cells.columns, days_of(found.on), pa.array(found.n.astype(np.int64)), pa.array(value), pa.array(low, pa.list_(pa.float64()))]
        yield from pa.table(columns, ["location_id", "item", "as_of", "n", "value", "lowest"]).to_batches()

    wanted = rows.select("location_id", "item", "observed_on", "unit_price", "factor")
    return by_block(wanted, ["location_id", "item"], back, made, "location_id long, item string, as_of date, n long, value double, lowest array<double>")


def _without(ascending: np.ndarray, n: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each of ``line`` the median of that row's first ``n`` but the one at ``place``; of all of them where place is -1, NaN of none."""
    left = n[line] - (place >= 0)
    own = np.where(place >= 0, place, np.iinfo(np.int64).max)
    low, high = np.maximum(left - 1, 0) // 2, left // 2
    a, b = (ascending[line, np.minimum(k + (own <= k), ascending.shape[1] - 1)] for k in (low, high))
    with np.errstate(invalid="ignore"):
        return np.where(left > 0, (a + b) / 2.0, np.nan)


def peers(rows: DataFrame, back: int) -> DataFrame:
    """rows with n_peers, local_median and mad: count, median, and median distance to it, of the valid others of the row's place and item on its day and ``back`` days before; null without any.

    rows: location_id, item, observed_on, unit_price, reporter_id, is_valid. Rows
    without a price are nobody's peers, those without a place, item or day have none. Whoever is left out of a window's sorted
    prices moves its middle by a place at most, so a window has four middles, and
    its distances are sorted for these alone.
    """

    def made(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        price, day, first = numbers(t, "unit_price").astype(float), numbers(t, "_day"), numbers(t, "_block") * BLOCK
        valid = np.asarray(t.column("is_valid").fill_null(False).to_numpy(), bool) & ~np.isnan(price)
        own = np.flatnonzero((day >= first) & (day < first + BLOCK))
        n, median, mad = np.zeros(len(day), np.int64), np.full(len(day), np.nan), np.full(len(day), np.nan)
        order = np.lexsort((price, block))
        found = windows(block, first, day, order[valid[order]], 0, back)
        key = block[own] * BLOCK + day[own] - first[own]
        by_key = np.argsort(key, kind="stable")
        own, key = own[by_key], key[by_key]
        window_key = found.block * BLOCK + found.on - first[found.row]
        begin, end = np.searchsorted(key, window_key, "left"), np.searchsorted(key, window_key, "right")
        for s in found.slabs():
            many = end[s.window] - begin[s.window]
            line = np.repeat(np.arange(len(s.window)), many)  # of each row, its window in the slab
            if not len(line):
                continue
            mine = own[np.repeat(begin[s.window], many) + np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)]
            values = np.where(s.inside, price[s.at], np.inf)
            # A valid row is in its window: its place is where the window's row is it.
            seat = np.full(len(day), -1)
            within = s.inside & (day[s.at] == found.on[s.window][:, None])
            seat[s.at[within]] = np.nonzero(within)[1]
            place = np.where(valid[mine], seat[mine], -1)
            size = s.n[line]
            n[mine] = size - (place >= 0)
            median[mine] = _without(values, s.n, line, place)
            lower, upper = (size - (place >= 0) - 1) // 2, (size - (place >= 0)) // 2
            kind = np.where(place < 0, 3, (place <= lower).astype(int) + (place <= upper))
            for k in range(4):
                these = np.flatnonzero((kind == k) & (n[mine] > 0))
                if not len(these):
                    continue
                lines, which = np.unique(line[these], return_inverse=True)
                centre = np.empty(len(lines))
                centre[which] = median[mine[these]]
                gap = np.abs(values[lines] - centre[:, None])
                ranked = np.argsort(gap, axis=1, kind="stable")
                rank = np.empty_like(ranked)
                np.put_along_axis(rank, ranked, np.broadcast_to(np.arange(gap.shape[1]), gap.shape), axis=1)
                place_of = np.where(k == 3, -1, rank[which, np.maximum(place[these], 0)])
                mad[mine[these]] = _without(np.take_along_axis(gap, ranked, axis=1), s.n[lines], which, place_of)
        kept = t.select(["location_id", "item", "observed_on", "reporter_id", "unit_price", "is_valid"]).take(pa.array(own))
        number = lambda x: pa.array(x[own], from_pandas=True)
        for name, values in (("n_peers", pa.array(n[own])), ("local_median", number(median)), ("mad", number(mad))):
            kept = kept.append_column(name, values)
        yield from kept.to_batches()

    wanted = rows.select("location_id", "item", "observed_on", "reporter_id", "unit_price", "is_valid")
    known = F.col("location_id").isNotNull() & F.col("item").isNotNull() & F.col("observed_on").isNotNull()
    alone = wanted.where(~known).withColumns({"n_peers": F.lit(0).cast("long"), "local_median": F.lit(None).cast("double"), "mad": F.lit(None).cast("double")})
    found = by_block(wanted.where(known), ["location_id", "item"], back, made, "location_id long, item string, observed_on date, reporter_id long, unit_price double, is_valid boolean, n_peers long, local_median double, mad double")
    return found.unionByName(alone)


def by_place(ascending: np.ndarray, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each place its own values' median and that of all others', NaN of none; and the median of all."""
    n = len(ascending)
    if not n:
        return np.full(places, np.nan), np.full(places, np.nan), np.nan
    own, m = np.argsort(place, kind="stable"), np.bincount(place, minlength=places)
    start = np.cumsum(m) - m
    shifted = own - (np.arange(n) - np.repeat(start, m))  # others before each of the own values
    keys, every = place[own] * np.int64(n + 1) + shifted, np.arange(places)

    def others(k: np.ndarray) -> np.ndarray:
        return ascending[np.minimum(k + np.searchsorted(keys, every * np.int64(n + 1) + k, "right") - start, n - 1)]

    left, last = n - m, n - 1
    mine = [ascending[own[np.minimum(start + np.maximum(k, 0), last)]] for k in ((m - 1) // 2, m // 2)]
    apart = (others(np.maximum(left - 1, 0) // 2) + others(left // 2)) / 2.0
    return np.where(m > 0, (mine[0] + mine[1]) / 2.0, np.nan), np.where(left > 0, apart, np.nan), float(ascending[last // 2] + ascending[n // 2]) / 2.0


def place_medians(rows: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """item, as_of, location_id and for each span name_own and name_others: medians of the place's own prices and of all other places'.

    rows: location_id, item, observed_on, unit_price, none null. spans: name ->
    days before as_of of the newest and the oldest prices. A row for each place
    that has prices in any of the days back to the oldest, and one of location
    null, which stands for places without.
    """
    back, names = max(last for _, last in spans.values()), [f"{s}_{side}" for s in spans for side in ("own", "others")]

    def made(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((numbers(t, "unit_price"), block))
        price, day, where = (numbers(t, c)[order] for c in ("unit_price", "_day", "location_id"))
        known, place = np.unique(where, return_inverse=True)
        ends = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            p, d, g, first = price[a:b], day[a:b], place[a:b], t.column("_block")[order[a]].as_py() * BLOCK
            item, found = t.column("item")[order[a]].as_py(), []
            for on in range(max(first, int(d.min())), min(first + BLOCK - 1, int(d.max()) + back) + 1):
                age = on - d
                seen = np.bincount(g[(age >= 0) & (age <= back)], minlength=len(known)) > 0
                if not seen.any():
                    continue
                columns = []
                for begin, end in spans.values():
                    inside = (age >= begin) & (age <= end)
                    own, others, plain = by_place(p[inside], g[inside], len(known))
                    columns += [np.append(own[seen], np.nan), np.append(others[seen], plain)]
                found.append((on, known[seen], columns))
            if not found:
                continue
            sizes = [len(k) + 1 for _, k, _ in found]
            at = pa.concat_arrays([pa.array([*k, None], pa.int64()) for _, k, _ in found])
            values = [pa.array(np.concatenate([c[i] for _, _, c in found]), from_pandas=True) for i in range(len(names))]
            columns = [pa.array([item] * sum(sizes), pa.string()), days_of(np.repeat([on for on, _, _ in found], sizes)), at, *values]
            yield from pa.table(columns, ["item", "as_of", "location_id", *names]).to_batches()

    wanted = rows.select("location_id", "item", "observed_on", "unit_price")
    return by_block(wanted, ["item"], back, made, f"item string, as_of date, location_id long, {', '.join(f'{n} double' for n in names)}")
