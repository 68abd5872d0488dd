"""Operator 10: repeated passages by collinear chaining of shared word k-mers.

Each document gives the least k-mer of every window of k-mers as a seed, so two
equal runs of WINDOW + K - 1 words share a seed; of wider windows (RUN_WINDOW)
it gives the RUN words that begin with the least k-mer, so two equal runs of
LEAST_WORDS words share such a run. Every seed and run is joined with its first
place in the corpus and with the nearest earlier document that has it; its
places number linearly, whatever its frequency, and those of hot ones are split
by ranges of documents. On request a run that no earlier document has is joined
with its first place in the document itself.

Matches of a document with another grow to runs of equal words. These are
chained in order of both documents, with gap costs, through a Fenwick tree of
prefix maxima; chains are aligned word by word, cut where they are not alike and
extended at their ends. Aligned pieces of one document that touch make one
passage, whatever their sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.shared import NARROW_ROWS, packed, released, stored, trimmed
from pricewell.llm.words import Words, inside, mix, ngrams, word_ends, words

K = 6
WINDOW = 12
#: Windows of k-mers whose least one begins a run, and the run's words: together LEAST_WORDS or fewer.
RUN_WINDOW, RUN = 18, 32
#: Words that a passage has at least.
LEAST_WORDS = 50
#: And a piece of one; two documents are compared if they share a run or so many seeds.
LEAST_PIECE = 20
LEAST_SEEDS = 3
IDENTITY = 0.8
#: Cost of a word in a gap, of either document. Pieces that lie further apart than LONGEST_GAP are judged by themselves.
GAP = 0.1
LONGEST_GAP = 4096
#: Words between two pieces of one passage at most.
TOUCH = 2
#: Documents up to which ids or spans are broadcast.
BROADCAST_ROWS = 1_000_000
#: A seed is hot if it makes up one in so many of a part of the documents' seeds; its places are dealt to tasks by ranges of doc_id.
HOT_SHARE, LEAST_HOT, HOT_PART, HOT_RANGES = 5000, 64, 16, 256
#: Rows of an Arrow batch where rows hold two documents' words.
PAIR_ROWS = 500


def least_places(w: Words, grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least k-mer of every window of k-mers of each text; of a text with fewer k-mers, of them all."""
    valid = inside(w.offsets, len(w.hashes), K)
    values = np.where(valid, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = np.zeros(len(values), bool)
    if len(values) >= window:
        view = np.lib.stride_tricks.sliding_window_view(values, window)
        full = np.flatnonzero(inside(w.offsets, len(w.hashes), K + window - 1)[: len(view)])
        chosen[full + view[full].argmin(axis=1)] = True
    counts = np.diff(w.offsets) - K + 1
    for i in np.flatnonzero((counts > 0) & (counts < window)).tolist():
        a = int(w.offsets[i])
        chosen[a + int(values[a : a + counts[i]].argmin())] = True
    return np.flatnonzero(chosen & valid)


def seed_places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the seeds (even) and runs (odd) of all texts of a run of texts."""
    grams = ngrams(w.hashes, K)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    at = least_places(w, grams, WINDOW)
    starts = least_places(w, grams, RUN_WINDOW)
    whole = inside(w.offsets, len(w.hashes), RUN)
    starts = starts[starts < len(whole)]
    starts = starts[whole[starts]]
    runs = np.zeros(len(starts), np.uint64)
    for i in range(RUN):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + w.hashes[starts + i]
    return np.concatenate([at, starts]), np.concatenate([grams[at] & ~np.uint64(1), mix(runs) | np.uint64(1)])


PLACES = "h long, part int, doc_id long, at int"


def seeds(docs: DataFrame, hot: np.ndarray | None = None, bounds: np.ndarray | None = None) -> DataFrame:
    """Rows of PLACES: seeds and runs; part is 0, of a hot one 1 and more by the range of doc_id."""
    hot = np.zeros(0, np.int64) if hot is None else hot

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                at, h = seed_places(w)
                h = h.view(np.int64)
                of = np.searchsorted(w.offsets, at, "right") - 1
                own = batch.column(0).slice(w.first, len(w)).take(pa.array(of))
                part = np.zeros(len(h), np.int32)
                if len(hot):
                    split = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
                    part[split] = 1 + np.searchsorted(bounds, own.to_numpy()[split])
                yield pa.record_batch([pa.array(h), pa.array(part), own, pa.array((at - w.offsets[of]).astype(np.int32))], names=["h", "part", "doc_id", "at"])

    return docs.mapInArrow(task, PLACES)


def hot_seeds(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot seeds, sorted, HOT_SHARE at most, and bounds of ranges of doc_id. From a part of the documents: this decides who works on what, not what is found."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PART)) == 0)
    counts = stored(seeds(some).groupBy("h").agg(F.count("*").alias("n")), "hot")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") > max(total // HOT_SHARE, LEAST_HOT)).select("h").toArrow().column(0).to_numpy()
    released(counts)
    if not len(hot):
        return hot, hot
    bounds = some.approxQuantile("doc_id", [i / HOT_RANGES for i in range(1, HOT_RANGES)], 1 / HOT_RANGES / 2)
    return np.sort(hot), np.unique(np.array(bounds, np.int64))


MATCHES = "doc_id long, at int, source long, there int, run boolean"


def carried(places: DataFrame) -> DataFrame:
    """For every range of a hot seed its first place of all and the last place before the range, as rows of PLACES with at turned to -1 - at."""
    place = F.struct("doc_id", "at")
    ranges = places.where("part > 0").groupBy("h", "part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    w = Window.partitionBy("h").orderBy("part")  # HOT_RANGES rows at most
    ranges = ranges.select("h", "part", F.first("first").over(w).alias("first"), F.lag("last").over(w).alias("last")).where("last is not null")
    rows = ranges.select("h", "part", F.explode(F.array("first", "last")).alias("p"))
    return rows.select("h", "part", "p.doc_id", (-1 - F.col("p.at")).cast("int").alias("at"))


def matches(places: DataFrame, within: bool = False) -> DataFrame:
    """Every place of a seed or run with its first place and with the last place in the document before, where these are other documents.

    within: a run that stands in no earlier document is matched with its first
    place in its own. Tasks read the places in order and keep three of them at most
    between batches.
    """

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(kept[0])
            h, part, doc, at = (np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns, strict=True))
            own, place = at >= 0, np.where(at >= 0, at, -1 - at)
            i = np.arange(len(h))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            first = np.maximum.accumulate(np.where(new, i, 0))
            new[1:] |= doc[1:] != doc[:-1]
            before = np.maximum.accumulate(np.where(new, i, 0)) - 1
            wanted, run = own & (i >= old), h & 1 == 1
            for source, mine in ((first, doc != doc[first]), (before, (before >= first) & (doc[before] != doc[first])), (first, within & run & (doc == doc[first]) & (place > place[first]))):
                mine = np.flatnonzero(mine & wanted)
                if len(mine):
                    yield pa.record_batch([pa.array(x) for x in (doc[mine], place[mine], doc[source[mine]], place[source[mine]], run[mine])], names=[x.split()[0] for x in MATCHES.split(", ")])
            last = np.unique([first[-1], max(before[-1], first[-1]), len(h) - 1])
            kept = (h[last], part[last], doc[last], at[last])

    return places.repartition("h", "part").sortWithinPartitions("h", "part", "doc_id", "at").mapInArrow(task, MATCHES)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words that two runs begin with."""
    done, n, whole = 0, 32, min(len(a), len(b))
    while done < whole:
        n = min(n, whole - done)
        differ = a[done : done + n] != b[done : done + n]
        stop = int(differ.argmax())
        if differ[stop]:
            return done + stop
        done, n = done + n, n * 8
    return whole


def equal_runs(found: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the longest equal runs that hold the matches; matches within a run of LEAST_PIECE words are passed over."""
    out, reach, ends = [], 0, {}
    for x, y in sorted(found):
        if x + K <= reach or ends.get(x - y, -1) >= x + K:
            continue
        right = _same(a[x:], b[y:])
        if right < K:  # rows of one id have other texts
            continue
        left = _same(a[:x][::-1], b[:y][::-1])
        ends[x - y] = x + right
        out.append((x - left, y - left, left + right))
        if left + right >= LEAST_PIECE:
            reach = max(reach, x + right)
    return out


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Disjoint ordered chains of equal runs (place here, place there, words), best first.

    A chain's score is its runs' words less GAP for each word of either side
    between them; a run starts a chain of its own where that is better. Runs may
    overlap by less than K words; a chain's later one gives way.
    """
    runs = sorted(runs)
    if len(runs) == 1:
        yield runs
        return
    ends = [(x + n - min(K - 1, n - 1), y + n - min(K - 1, n - 1)) for x, y, n in runs]
    rank = {y: i + 1 for i, y in enumerate(sorted({y for _, y in ends} | {y for _, y, _ in runs}))}
    tree, score, back = Fenwick(len(rank)), [], []
    waiting: list[tuple[int, int]] = []
    for i, (x, y, n) in enumerate(runs):
        while waiting and waiting[0][0] <= x:
            _, j = heapq.heappop(waiting)
            tree.put(rank[ends[j][1]], (score[j] + GAP * sum(ends[j]), j))
        before, j = tree.get(rank[y])
        gain = before - GAP * (x + y)
        if gain > 0 and max(x - ends[j][0], y - ends[j][1]) > LONGEST_GAP:
            gain = 0.0
        score.append(n + max(gain, 0.0))
        back.append(j if gain > 0 else -1)
        heapq.heappush(waiting, (ends[i][0], i))
    used = [False] * len(runs)
    for i in sorted(range(len(runs)), key=lambda i: (-score[i], i)):
        chain: list[tuple[int, int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = back[i]
        if chain:
            yield _apart(chain[::-1])


def _apart(chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = chain[:1]
    for x, y, n in chain[1:]:
        x0, y0, n0 = out[-1]
        over = max(x0 + n0 - x, y0 + n0 - y, 0)
        if over < n:
            out.append((x + over, y + over, n - over))
    return out


class Piece(NamedTuple):
    first: int
    last: int  # one after
    there: int
    there_last: int
    equal: int


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs go on alike from their beginnings, and how many words are equal there."""
    walk = best = equal = far = kept = 0
    for i, (x, y) in enumerate(zip(a[:24].tolist(), b[:24].tolist()), 1):  # most walks end here
        if x == y:
            walk, equal = walk + 1, equal + 1
            if walk > best:
                best, far, kept = walk, i, equal
        else:
            walk -= 2
            if best - walk > 6:
                return far, kept
    whole, n = min(len(a), len(b)), 128
    if whole <= 24:
        return far, kept
    while True:
        n = min(n, whole)
        same = a[:n] == b[:n]
        walk = np.where(same, 1, -2).cumsum()
        peak = np.maximum.accumulate(np.maximum(walk, 0))
        stop = peak - walk > 6
        end = int(stop.argmax())
        if stop[end] or n == whole:
            if not stop[end]:
                end = n
            far = int(walk[:end].argmax()) + 1
            return (far, int(np.count_nonzero(same[:far]))) if walk[far - 1] > 0 else (0, 0)
        n *= 8


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two gaps; a row of the table is one integer, a bit a word of b."""
    if len(a) == len(b):
        equal = int((a == b).sum())
        if 2 * equal >= len(a):
            return equal
    places: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & places.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _core(chain: list[tuple[int, int, int]], equal: int) -> Piece:
    """From the first run to the last one's end."""
    (x0, y0, _), (x, y, n) = chain[0], chain[-1]
    return Piece(x0, x + n, y0, y + n, equal)


def _extended(chain: list[tuple[int, int, int]], equal: int, a: np.ndarray, b: np.ndarray) -> Piece:
    """The same with what goes on alike at both ends."""
    (x0, y0, _), (x, y, n) = chain[0], chain[-1]
    left, before = _extend(a[:x0][::-1], b[:y0][::-1])
    right, after = _extend(a[x + n :], b[y + n :])
    return Piece(x0 - left, x + n + right, y0 - left, y + n + right, before + equal + after)


def _alike(p: Piece) -> bool:
    return p.equal >= IDENTITY * max(p.last - p.first, p.there_last - p.there)


def segments(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> Iterator[Piece]:
    """The chain's alike pieces; a and b are the documents' words.

    A chain that is alike as a whole is one piece, unless a stretch between two
    runs is not alike and what lies on either side is a passage by itself. Any
    other chain is cut at the stretch with the most differing words, and both
    sides are judged by themselves.
    """
    gaps = [(x + n, y + n, nx, ny) for (x, y, n), (nx, ny, _) in zip(chain, chain[1:])]
    equal = [_common(a[x:nx], b[y:ny]) if nx > x and ny > y else 0 for x, y, nx, ny in gaps]
    longest = [max(nx - x, ny - y) for x, y, nx, ny in gaps]
    other = [n - e for n, e in zip(longest, equal, strict=True)]
    total = [0, *accumulate(n + e for (_, _, n), e in zip(chain, [*equal, 0], strict=True))]

    def words_of(first: int, last: int) -> int:
        return total[last] - total[first] - (equal[last - 1] if last <= len(equal) else 0)

    def whole(first: int, last: int) -> Piece:
        return _extended(chain[first:last], words_of(first, last), a, b)

    def is_passage(first: int, last: int) -> bool:
        p = whole(first, last)
        return p.last - p.first >= LEAST_WORDS and _alike(p)

    todo = [(0, len(chain))]
    while todo:
        first, last = todo.pop()
        found = next((p for p in (whole(first, last), _core(chain[first:last], words_of(first, last))) if _alike(p)), None)
        if found:
            unlike = [i for i in range(first, last - 1) if other[i] > max(LEAST_PIECE, (1 - IDENTITY) * longest[i])]
            at = next((i for i in sorted(unlike, key=lambda i: (-other[i], i)) if is_passage(first, i + 1) and is_passage(i + 1, last)), -1)
            if at < 0:
                yield found
                continue
        else:
            at = max(range(first, last - 1), key=lambda i: (other[i], -i))
        todo += [(at + 1, last), (first, at + 1)]


def word_codes(docs: DataFrame) -> DataFrame:
    """doc_id, codes: four bytes of each word's hash."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(w.first, len(w)), packed(w.hashes.astype(np.uint32), w.offsets)], names=["doc_id", "codes"])

    return docs.mapInArrow(task, "doc_id long, codes binary")


PIECES = "doc_id long, first int, last int, source_doc_id long, source_first int, source_last int, equal int"


def pieces(docs: DataFrame, within: bool = False) -> DataFrame:
    """Aligned pieces of every document with documents of smaller id; within: and with earlier places of its own."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hot, bounds = hot_seeds(docs)
    places = seeds(docs, hot, bounds)
    if len(hot):
        places = places.unionByName(carried(seeds(docs, hot, bounds)))
    found = matches(places, within)
    enough = (F.size("m") >= LEAST_SEEDS) | F.exists("m", lambda m: m["run"])
    grouped = found.groupBy("doc_id", "source").agg(F.collect_list(F.struct("at", "there", "run")).alias("m")).where(enough)
    grouped = stored(grouped.select("doc_id", "source", "m.at", "m.there"), "matches", NARROW_ROWS)

    ids = stored(grouped.select(F.explode(F.array("doc_id", "source")).alias("doc_id")).distinct(), "ids")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    codes = word_codes(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    codes = stored(codes.groupBy("doc_id").agg(F.max("codes").alias("codes")), "codes")
    rows = grouped.join(codes, "doc_id").join(codes.select(F.col("doc_id").alias("source"), F.col("codes").alias("source_codes")), "source")

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, source, at, there, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                for chain in chains(equal_runs(list(zip(at, there, strict=True)), a, b)):
                    out += [(doc, p.first, p.last, source, p.there, p.there_last, p.equal) for p in segments(chain, a, b) if p.last - p.first >= LEAST_PIECE]
            if out:
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int64() if i in (0, 3) else pa.int32()) for i in range(7)], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.select("doc_id", "source", "at", "there", "codes", "source_codes").mapInArrow(task, PIECES)


def passages(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, first_word, n_words, source_doc_id, source_first_word, source_n_words, n_equal, n_pieces: a row a repeated passage.

    docs: doc_id, text; other columns are ignored. A passage has LEAST_WORDS or
    more words that stand in documents of smaller id; within: or, RUN words at
    least of them equal, earlier in the document itself. The first document that holds it is its source and keeps it. source_
    and n_equal describe the passage's longest piece. Null ids, null or empty
    texts and texts under K words give no rows. Equal rows of one id are one
    document; of different texts under one id only one is compared (the last by
    its words' codes), which loses what only the others hold. An empty table
    gives no rows.
    """
    rows = stored(pieces(docs, within), "pieces", PAIR_ROWS)
    w = Window.partitionBy("doc_id").orderBy("first", "last", "source_doc_id", "source_first")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (F.col("first") > F.coalesce(reach, F.lit(-10)) + TOUCH).cast("int")).withColumn("part", F.sum("new").over(w))
    longest = F.max_by(F.struct("source_doc_id", "source_first", "source_last", "equal"), F.struct(F.col("last") - F.col("first"), -F.col("source_doc_id"), -F.col("source_first")))
    out = rows.groupBy("doc_id", "part").agg(F.min("first").alias("first_word"), F.max("last").alias("last"), longest.alias("s"), F.count("*").alias("n_pieces"))
    out = out.withColumn("n_words", F.col("last") - F.col("first_word")).where(F.col("n_words") >= LEAST_WORDS)
    return out.select("doc_id", "first_word", "n_words", "s.source_doc_id", F.col("s.source_first").alias("source_first_word"), (F.col("s.source_last") - F.col("s.source_first")).alias("source_n_words"), F.col("s.equal").alias("n_equal"), "n_pieces")


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the passages found in them; a document with no word left goes. Its other columns stay as they are, whatever their names."""
    spans = stored(found.groupBy(F.col("doc_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans")), "spans")
    few = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names, at = docs.columns, docs.columns.index("text")
    packed_rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    rows = packed_rows.join(F.broadcast(spans) if few else spans, F.col("_id") == F.col("_of"), "left").select("_row", "_spans")

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.column(0).flatten(), batch.column(1).to_pylist()
            texts = columns[at].to_pylist()
            keep = np.ones(len(texts), bool)
            for i, found in enumerate(spans):
                if found and texts[i] is not None:
                    texts[i] = _cut(texts[i], [(s["first_word"], s["n_words"]) for s in found])
                    keep[i] = bool(texts[i].strip())
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names).filter(pa.array(keep))

    return rows.mapInArrow(task, docs.schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (first word, words), as far as it has these words."""
    w = next(iter(words(pa.array([text], pa.string()))))
    ends, raw, out, at = word_ends(w), w.raw.tobytes(), [], 0
    for first, n in spans:
        if first < len(ends):
            out.append(raw[at : w.starts[first]])
            at = int(ends[min(first + n, len(ends)) - 1])
    out.append(raw[at:])
    return b"".join(out).decode()
