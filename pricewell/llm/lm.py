"""Operator 9: language-model scores from a log-frequency Bloom filter.

Every training n-gram's count is quantised to a level on a logarithmic scale,
and the filter holds the n-gram once for each level up to its own. A count is
read back by probing level after level until one is missing. Workers get the
filter by broadcast; its size is bounded (MOST_BITS). N-grams that occur once are
most of all n-grams and never enter it; where the others don't all fit, it holds
the levels from some higher level on. Tokens with an n-gram that it doesn't hold
are joined with the levels of the others, so every n-gram of the training texts
is in the model at every size. If the filter lacks single occurrences alone,
training texts need no join: what it doesn't hold of theirs occurs once. Counts
are exact sums over all training texts, made with partial sums before the shuffle.

The base score needs exact counts of single words: the HEAD most frequent words
are broadcast, and only the other words of each text are joined with their
counts, so no frequent key meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import most_frequent, stored, trimmed
from pricewell.llm.words import Words, mix, words

#: Words whose exact counts every task holds; 16 bytes each.
HEAD = 500_000
#: The filter's size bound: 64 MB. Beyond it the least frequent n-grams are looked up by a join.
MOST_BITS = 1 << 29
BITS_PER_ENTRY = 10
HASHES = 4
BLOCK_BITS = 1 << 16
#: Parts that tasks make on their own.
GROUPS = 64
#: Ratio of two levels' counts, and the levels there are.
RATIO = 1.5
LEVELS = 64
#: Level of what occurs once; the filter holds higher ones.
ONCE = 1
#: Weight of the pair's own ratio against the single word's.
PAIR_WEIGHT = 0.5
#: Tokens counted at once within a task.
RUN = 4_000_000

END = np.uint64(0x5851F42D4C957F2C)
START = np.uint64(0x14057B7EF767814E)
_ONE = np.uint64(1)
_RATIO_LOG = math.log(RATIO)
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)


def single_keys(hashes: np.ndarray) -> np.ndarray:
    return hashes & ~_ONE


def pair_keys(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + hashes) | _ONE


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then END; what stands before each; the texts' bounds."""
    n = len(w)
    bounds = w.offsets + np.arange(n + 1)
    out = np.full(bounds[-1], END, np.uint64)
    word = np.ones(len(out), bool)
    word[bounds[1:] - 1] = False
    out[word] = w.hashes
    before = np.concatenate([[START], out[:-1]]) if n else out
    before[bounds[:-1]] = START
    return out, before, bounds


def count_ngrams(docs: DataFrame, training: Column) -> DataFrame:
    """h long, n long: exact counts of all words (even h) and all pairs (odd h), over the training rows."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, pairs, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for parts in (singles, pairs):
                if parts:
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    for i in range(0, len(keys), 200_000):
                        yield pa.record_batch([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], names=["h", "n"])

        for batch in batches:
            for w in words(batch.column(0)):
                t, before, _ = tokens(w)
                singles.append(single_keys(t))
                pairs.append(pair_keys(before, t))
                size += len(t)
                if size >= RUN:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.where(training).select(F.col("text").cast("string")).mapInArrow(task, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Filter(NamedTuple):
    """All bits of a key lie in one block; blocks divide by GROUPS."""

    bits: np.ndarray  # uint8
    blocks: int

    def block(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys) % np.uint64(self.blocks)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """0 where a key isn't held, else the highest level in a row that is found. Keys are probed block by block, so a block's bits are near when they are read."""
        out = np.zeros(len(keys), np.int64)
        block = self.block(keys)
        active = np.argsort(block.astype(np.uint16) if self.blocks <= 1 << 16 else block, kind="stable")  # 16 bits are sorted by digits
        mine, own = keys[active], block[active] * np.uint64(BLOCK_BITS)
        for level in range(1, LEVELS + 1):
            h = _spread(mine, level)
            for _ in range(HASHES):
                at = (own + (h & np.uint64(BLOCK_BITS - 1))).view(np.int64)
                hit = np.flatnonzero(self.bits[at >> 3] & _BIT[at & 7])
                if not len(hit):
                    return out
                active, mine, own, h = active[hit], mine[hit], own[hit], h[hit] >> np.uint64(16)
            out[active] = level
        return out


def word_levels(bloom: Filter, keys: np.ndarray, in_head: np.ndarray, at: np.ndarray, head_levels: np.ndarray) -> np.ndarray:
    """The filter's levels of the keys; it is asked for those alone that are not in the head, whose levels (at) it gave before."""
    out = np.zeros(len(keys), np.int64)
    out[in_head] = head_levels[at[in_head]]
    out[~in_head] = bloom.levels(keys[~in_head])
    return out


def level_of(n: Column) -> Column:
    return F.least(F.lit(LEVELS), F.floor(F.log(n.cast("double")) / F.lit(_RATIO_LOG) + F.lit(1e-9)).cast("int") + 1)


#: The count that a level stands for, by level.
COUNTS = np.concatenate([[0.0], np.maximum(1.0, RATIO ** (np.arange(1, LEVELS + 1) - 0.5))])
COUNTS[1] = 1.0


def build(counts: DataFrame) -> tuple[Filter, int]:
    """The filter of stored counts and the least level in it; its blocks are made by the tasks and put together on the driver, MOST_BITS at most."""
    leveled = counts.select("h", level_of(F.col("n")).alias("level"))
    sizes = {r["level"]: r["count"] for r in leveled.groupBy("level").count().collect()}
    least = ONCE + 1
    while (entries := sum(v * k for k, v in sizes.items() if k >= least)) * BITS_PER_ENTRY > MOST_BITS and least < LEVELS:
        least += 1
    per_group = max(1, min(math.ceil(entries * BITS_PER_ENTRY / BLOCK_BITS / GROUPS), MOST_BITS // BLOCK_BITS // GROUPS))
    blank = Filter(np.zeros(0, np.uint8), per_group * GROUPS)
    size = per_group * BLOCK_BITS

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = blank.block(batch.column(0).to_numpy().view(np.uint64)) // np.uint64(per_group)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(group.astype(np.int32))], names=["h", "level", "part"])

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of the task's groups of blocks; each takes MOST_BITS / GROUPS bytes meanwhile."""
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, levels, group = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for number in np.unique(group).tolist():
                flags = made.setdefault(number, np.zeros(size, bool))
                mine, high = keys[group == number], levels[group == number]
                own = (blank.block(mine) - np.uint64(number * per_group)) * np.uint64(BLOCK_BITS)
                for level in range(1, int(high.max()) + 1):
                    held = high >= level
                    h = _spread(mine[held], level)
                    for _ in range(HASHES):
                        flags[own[held] + (h & np.uint64(BLOCK_BITS - 1))] = True
                        h = h >> np.uint64(16)
        for number, flags in made.items():
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    rows = leveled.where(F.col("level") >= least).mapInArrow(keyed, "h long, level int, part int")
    bits = np.zeros(size * GROUPS // 8, np.uint8)
    made = rows.repartition(GROUPS, "part").sortWithinPartitions("part").mapInArrow(task, "part int, bits binary").toArrow()
    for part, own in zip(made.column(0), made.column(1), strict=True):
        at = part.as_py() * size // 8
        bits[at : at + size // 8] = np.frombuffer(own.as_buffer(), np.uint8)
    return Filter(bits, blank.blocks), least


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row a row of docs.

    docs: doc_id, text; other columns only serve ``training``, which is true for
    rows to learn from. A null text is empty: its one token is the end. Equal
    rows are scored each, a null doc_id stays null, an empty table gives no
    rows. Without training rows, N and V are 0 and every token is unknown.
    """
    spark = docs.sparkSession
    counts = stored(count_ngrams(docs, F.coalesce(training, F.lit(False))), "ngrams")
    singles = counts.where("h % 2 = 0")
    total, kinds = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = most_frequent(singles, HEAD, kinds).toArrow().sort_by("h")
    whole_head = kinds <= HEAD
    bloom, least = build(counts)
    scale = total + 0.5 * (kinds + 1)
    starts = int(END.view(np.int64) & ~1)  # the end token's count: training texts
    head_keys, head_counts = (head.column(c).to_numpy() for c in ("h", "n"))
    starts = int(head_counts[head_keys == starts].sum())
    # The filter is asked for the head's words once here, not by every task for every run of texts.
    shared = spark.sparkContext.broadcast((bloom, head_keys, head_counts, bloom.levels(head_keys.view(np.uint64)).astype(np.uint8)))

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, keys, ns, head_levels = shared.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for w in words(batch.column(1)):
                t, before, bounds = tokens(w)
                n = np.diff(bounds)
                unique, back = np.unique(single_keys(t), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, unique.view(np.int64)), max(len(keys) - 1, 0))
                in_head = keys[at] == unique.view(np.int64) if len(keys) else np.zeros(len(unique), bool)
                exact = np.where(in_head, ns[at] if len(keys) else 0, 0)
                settled = in_head | whole_head
                base = np.where(settled, np.log10((exact + 0.5) / scale), 0.0)

                # If the filter lacks single occurrences alone, what it doesn't hold of a training text occurs once.
                once = np.repeat(batch.column(2).slice(w.first, len(w)).to_numpy(zero_copy_only=False) & (least == ONCE + 1), n)
                level = word_levels(bloom, unique, in_head, at, head_levels)
                found = (level >= least)[back]
                single = np.where(once & ~found, 1.0, COUNTS[level][back])
                pairs = pair_keys(before, t)
                pair, pair_back = np.unique(pairs, return_inverse=True)
                pair_level = bloom.levels(pair)[pair_back]
                pair_count = np.where(once & (pair_level < least), 1.0, COUNTS[pair_level])
                before_count = np.empty(len(t))
                before_count[1:] = single[:-1]
                before_count[bounds[:-1]] = max(starts, 1)
                ratio = np.minimum(pair_count / np.maximum(before_count, 1.0), 1.0)
                p = np.log10((1 - PAIR_WEIGHT) * (single + 0.5) / scale + PAIR_WEIGHT * ratio)
                open_single, open_pair = ~(found | once), (pair_level < least) & ~once
                open_before = np.concatenate([[False], open_single[:-1]])
                open_before[bounds[:-1]] = False
                words_open = open_single | open_before
                unsure, pair_only = np.flatnonzero(words_open), np.flatnonzero(open_pair & ~words_open)
                p[unsure] = p[pair_only] = 0.0
                sums = lambda x, b=bounds: np.add.reduceat(x, b[:-1])
                rows = np.arange(row, row + len(n))
                row += len(n)
                yield _batch(len(n), row=pa.array(rows), doc_id=batch.column(0).slice(w.first, len(w)), n_tokens=pa.array(n), n_known=pa.array(sums((exact > 0)[back].astype(np.int64))), base_score=pa.array(sums(base[back])), score=pa.array(sums(p)))
                of = np.repeat(rows, n)
                late = np.flatnonzero(~settled[back])
                if len(late):
                    yield _batch(len(late), row=pa.array(of[late]), h=pa.array(unique[back[late]].view(np.int64)), k=pa.array(np.ones(len(late), np.int64)))
                if len(pair_only):
                    yield _batch(len(pair_only), row=pa.array(of[pair_only]), pair_h=pa.array(pairs[pair_only].view(np.int64)), single_n=pa.array(single[pair_only]), before_n=pa.array(before_count[pair_only]))
                if len(unsure):
                    h = unique[back].view(np.int64)
                    previous = np.concatenate([[0], h[:-1]])
                    known = lambda c, o: pa.array(c[unsure], mask=o[unsure])  # noqa: B023, E731
                    yield _batch(len(unsure), row=pa.array(of[unsure]), at=pa.array(unsure), single_h=pa.array(h[unsure]), single_n=known(single, open_single), pair_h=pa.array(pairs[unsure].view(np.int64)), pair_n=known(pair_count, open_pair), before_h=pa.array(previous[unsure]), before_n=known(before_count, open_before))

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(training, F.lit(False)).alias("training"))
    rows = stored(texts.mapInArrow(task, SCHEMA), "scores")
    done = rows.where("n_tokens is not null")
    if not whole_head:
        log = lambda c: F.log10((c + F.lit(0.5)) / F.lit(scale))
        n = F.coalesce(F.col("c"), F.lit(0))
        late = rows.where("h is not null").groupBy("row", "h").agg(F.sum("k").alias("k")).join(singles.select("h", F.col("n").alias("c")), "h", "left")
        late = late.groupBy("row").agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * log(n)).alias("rest"))
        done = done.join(late, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("rest", F.lit(0.0))})
    rest = _late_scores(rows, counts.select("h", level_of(F.col("n")).alias("level")).where(F.col("level") < least), scale)
    done = done.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("late_score", F.lit(0.0)))
    return done.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _late_scores(rows: DataFrame, levels: DataFrame, scale: float) -> DataFrame:
    """row, late_score: of the tokens with n-grams that the filter doesn't hold; levels: h, level of these.

    Tokens that lack their pair alone carry the words' counts with them and have no
    place (at); of the others each n-gram is a row of its own. All are looked up in
    one join, so the levels are shuffled once.
    """
    numbers = F.array(*(F.lit(float(c)) for c in COUNTS))
    none = F.lit(None).cast("double")

    def p(single: str, pair: str, before: str) -> Column:
        ratio = F.least(F.col(pair) / F.greatest(F.col(before), F.lit(1.0)), F.lit(1.0))
        return F.log10(F.lit(1 - PAIR_WEIGHT) * (F.col(single) + F.lit(0.5)) / F.lit(scale) + F.lit(PAIR_WEIGHT) * ratio)

    roles = ("single", "pair", "before")
    grams = rows.where("at is not null").select("row", "at", F.inline(F.array(*(F.struct(F.lit(i).alias("role"), F.col(f"{r}_h").alias("h"), F.col(f"{r}_n").alias("n")) for i, r in enumerate(roles)))))
    pairs = rows.where("pair_h is not null and at is null").select("row", "at", F.lit(roles.index("pair")).alias("role"), F.col("pair_h").alias("h"), "single_n", "before_n")
    asked = pairs.unionByName(grams.where("n is null").select("row", "at", "role", "h", none.alias("single_n"), none.alias("before_n")))
    joined = asked.join(levels, "h", "left").withColumn("n", F.element_at(numbers, F.coalesce("level", F.lit(0)) + 1))
    joined = joined.select("row", "at", "role", "n", F.when(F.col("at").isNull(), p("single_n", "n", "before_n")).alias("p"))
    whole = joined.unionByName(grams.where("n is not null").select("row", "at", "role", "n", none.alias("p")))
    whole = whole.groupBy("row", "at").agg(F.sum("p").alias("p"), *(F.max(F.when(F.col("role") == i, F.col("n"))).alias(r) for i, r in enumerate(roles)))
    return whole.groupBy("row").agg(F.sum(F.when(F.col("at").isNull(), F.col("p")).otherwise(p(*roles))).alias("late_score"))


SCHEMA = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, h long, k long, at long, single_h long, single_n double, pair_h long, pair_n double, before_h long, before_n double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of SCHEMA; the other columns are null."""
    kinds = {"double": pa.float64(), "long": pa.int64()}
    return pa.record_batch([columns[name] if name in columns else pa.nulls(n, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))], names=NAMES)
