"""Operator 5: exact n-gram Jaccard join with token-combination prefixes.

A document is its set of word n-grams; equal sets are one class. In a fixed
order of the grams (frequent ones last, then by hash) two sets that are similar
enough share a gram within their prefixes. A first pass counts the grams of
slightly longer prefixes in order of hash; those that more than RARE sets have
are frequent, so prefixes extend past them and index rare grams alone. Sets with
too few rare grams for a prefix, or with a frequent gram that the count did not
show, are indexed by combinations of the whole set: a hash deals the grams into
so many parts that similar sets must agree on one part, all of its grams
together. Candidates pass a parity bitmap, whose distance never exceeds the
sets' true difference, and are then verified on the sets themselves.

A group of the index yields all its pairs only up to RARE members. Of a larger
group each member is paired with one leader, its smallest key; large groups of
one leader, which near copies have by the dozen, count as one from there on.
Members that then still lie outside the leader's component are compared with all
others block by block, so no link between components is lost. Which grams count
as frequent changes the amount of work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.graph import components
from pricewell.llm.shared import most_frequent, packed, released, stored, trimmed
from pricewell.llm.words import Words, inside, mix, ngrams, words

#: Members of an index group up to which all its pairs are candidates.
RARE = 32
#: Frequent grams whose order is last at most, 8 bytes each in every task; rarer ones beyond them lead to combinations.
MOST_COMMON = 1_000_000
#: The counted prefix is longer by a part of the prefix and by so many grams.
MARGIN_PART, MARGIN = 4, 8
#: Members of a block of a large group; blocks are compared as a whole, and only pairs that may be similar become rows.
BLOCK = 256
#: Cells of a bitmap at least. A set of 40 grams in 64 cells hides so much of a difference that many pairs beyond the limit pass.
CELLS = 256
#: Grams counted at once within a task.
RUN = 4_000_000
#: Representatives up to which their ids are broadcast to pick their texts.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch where rows hold whole sets or blocks.
SET_ROWS, BLOCK_ROWS = 1000, 16


class Rule:
    """Similar: percent * |union| <= 100 * |intersection|, on n-grams of n words."""

    def __init__(self, n: int, percent: int) -> None:
        self.n, self.percent, self.edges = n, percent, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // percent + 1)

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def difference(self, total: int) -> int:
        """Most grams that only one of two similar sets has, of sizes adding up to total."""
        return total * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a scheme, and how many of them may hold a gram or none in a set without making them evidence."""
        differ = self.difference(2 * (self.edges[band + 1] - 1))
        spare = 1 + differ // 8
        return differ + 1 + spare, spare

    def bands(self, size: int) -> tuple[int, int]:
        band = int(np.searchsorted(self.edges, size, "right")) - 1
        return band, band + 1


def gram_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct grams of each text; of one with fewer words its whole sequence, without words none."""
    grams, off = ngrams(w.hashes, n), w.offsets
    for i in range(len(w)):
        a, b = off[i], off[i + 1]
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield ngrams(w.hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each of as many cells as the set has grams (a power of two, CELLS at least): whether an odd number of grams fall there."""
    cells = max(CELLS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool))


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Cells that differ, at the smaller size: the larger folds by exclusive or, as its cells' numbers do by their low bits."""
    for x, y in ((a, b), (b, a)):
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        if x is not a and x is not b:
            return int(np.bitwise_count(x ^ y).sum())
    return int(np.bitwise_count(a ^ b).sum())


def combinations(s: np.ndarray, rule: Rule) -> Iterator[np.ndarray]:
    """Hashes of the parts of a set under the schemes of its size."""
    for band in rule.bands(len(s)):
        if not rule.difference(2 * (rule.edges[band + 1] - 1)):
            continue  # similar sets of this size are equal, and of one class
        parts, spare = rule.parts(band)
        part = (mix(s + np.uint64(band + 1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        sums = np.add.reduceat(mix(s[order] ^ np.uint64(0x9FB21C651E98DF25)), cut)
        seed = np.uint64(band << 40)
        keys = mix(sums + mix(part[order][cut].astype(np.uint64) + seed))
        strong = np.diff(np.append(cut, len(s))) > 1
        if parts - strong.sum() <= spare:  # similar sets agree on more parts than may be weak
            yield keys[strong]
        else:
            yield keys
            empty = np.setdiff1d(np.arange(parts), part)
            yield mix(mix(empty.astype(np.uint64) + seed) ^ np.uint64(0xA0761D6478BD642F))


MEASURED = "doc_id long, n long, key long, bitmap binary"


def measure(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row a document; n is 0 and the key null without words."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                sets = list(gram_sets(w, rule.n))
                keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
                maps = pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.record_batch([batch.column(0).slice(w.first, len(w)), pa.array([len(s) for s in sets], pa.int64()), keys, maps], names=["doc_id", "n", "key", "bitmap"])

    return docs.mapInArrow(task, MEASURED)


def _new_sets(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Runs of (key, set) of a task's texts (column 1), each class once."""
    seen: set[int] = set()
    for batch in batches:
        for w in words(batch.column(1)):
            out = []
            for s in gram_sets(w, n):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    out.append((key, s))
            yield out


def early_counts(docs: DataFrame, rule: Rule) -> DataFrame:
    """h, n: in how many sets a gram is among the first ones by hash, a little more than a prefix; partial sums by task."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            if run:
                grams, times = np.unique(np.concatenate(run), return_counts=True)
                for i in range(0, len(grams), 200_000):
                    yield pa.record_batch([pa.array(grams[i : i + 200_000].view(np.int64)), pa.array(times[i : i + 200_000])], names=["h", "n"])

        for sets in _new_sets(batches, rule.n):
            for _, s in sets:
                most = rule.prefix(len(s))
                run.append(s[: most + most // MARGIN_PART + MARGIN])
                size += len(run[-1])
            if size >= RUN:
                yield from counted()
                run, size = [], 0
        yield from counted()

    return docs.mapInArrow(task, "h long, n long")


POSTINGS = "h long, key long, n int, at int"


def _table(parts: list[tuple[np.ndarray, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Rows of POSTINGS; a part is hashes, key, n, places in the prefix."""
    sizes = [len(p[0]) for p in parts]
    flat = np.concatenate([p[0] for p in parts]).view(np.int64)
    of = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), sizes)
    at = np.concatenate([p[3] for p in parts]).astype(np.int32)
    return pa.record_batch([pa.array(flat), pa.array(of(1, np.int64)), pa.array(of(2, np.int32)), pa.array(at)], names=["h", "key", "n", "at"])


def index_grams(docs: DataFrame, rule: Rule, common: Broadcast) -> DataFrame:
    """Postings of prefix grams that aren't frequent; a set with too few of them also gives a row with its key as h and a place of -1."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = common.value
        for sets in _new_sets(batches, rule.n):
            out = []
            for key, s in sets:
                late = np.zeros(len(s), bool)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                whole = rule.prefix(len(s))
                prefix = s[~late][:whole]
                out.append((prefix, key, len(s), np.arange(len(prefix))))
                if len(prefix) < whole:
                    out.append((np.array([key], np.int64).view(np.uint64), key, len(s), np.array([-1])))
            if out:
                yield _table(out)

    return docs.mapInArrow(task, POSTINGS)


def index_combinations(docs: DataFrame, rule: Rule) -> DataFrame:
    """Postings of the combinations of all sets; the place means nothing."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _new_sets(batches, rule.n):
            out = [(c, key, len(s), np.zeros(len(c))) for key, s in sets for c in combinations(s, rule)]
            if out:
                yield _table(out)

    return docs.mapInArrow(task, POSTINGS)


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.rule = Rule(n, percent)
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.measured = stored(measure(self.docs, self.rule), "sets")
        self.classes = stored(self.measured.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("bitmap").alias("bitmap")), "classes")

    def frequent(self) -> Broadcast:
        """The grams that more than RARE sets have early, sorted; MOST_COMMON at most."""
        counts = stored(early_counts(self.docs, self.rule).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > RARE), "frequent")
        kept = most_frequent(counts, MOST_COMMON, counts.count()).select("h").toArrow()
        released(counts)
        return self.docs.sparkSession.sparkContext.broadcast(np.sort(kept.column(0).to_numpy().view(np.uint64)))

    def texts(self, keys: DataFrame) -> DataFrame:
        """Documents (doc_id, text) that stand for the keys' classes."""
        ids = stored(self.classes.join(keys.select("key").distinct(), "key", "left_semi").select("doc_id"), "ids")
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(self, keys: DataFrame) -> DataFrame:
        """key, grams: the keys' sets, stored; shuffled only where a doc_id that repeats gives a key more than once."""
        n = self.rule.n

        @trimmed
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in words(batch.column(1)):
                    sets = list(gram_sets(w, n))
                    bounds = np.cumsum([0, *map(len, sets)])
                    yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.int64()), packed(np.concatenate(sets), bounds)], names=["key", "grams"])

        sets = stored(self.texts(keys).mapInArrow(task, "key long, grams binary"), "grams")
        if sets.groupBy("key").count().where("count > 1").isEmpty():
            return sets
        once = stored(sets.dropDuplicates(["key"]), "grams")
        released(sets)
        return once

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose bitmaps allow similarity."""
        maps, rule = self.classes.select("key", "n", "bitmap"), self.rule
        for side in "ab":
            pairs = pairs.join(maps.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"map_{side}")), side)
        rows = pairs.select("a", "b", "n_a", "n_b", "map_a", "map_b")

        @trimmed
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = [x + y for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                maps = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), total, strict=True)
                ok = [distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= rule.difference(t) for x, y, t in maps]
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return rows.mapInArrow(task, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are similar, by their sets. Each side meets only the sets that it names; a node has few a, an a many nodes, so b comes first."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("key")))
        named = pairs
        for side in "ba":
            own = sets.select(F.col("key").alias(side), F.col("grams").alias(f"set_{side}")).join(named.select(side).distinct(), side, "left_semi")
            pairs = pairs.join(own, side)
        percent = self.rule.percent

        @trimmed
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return pairs.select("a", "b", "set_a", "set_b").mapInArrow(task, "a long, b long")

    def pairs(self, groups: DataFrame) -> DataFrame:
        """Pairs of members of each group that sizes and places allow."""
        a = groups.select("h", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
        b = groups.select("h", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
        p = self.rule.percent
        rows = a.join(b, "h").where("a < b").where((F.greatest("n_a", "n_b") * p <= F.least("n_a", "n_b") * 100))
        most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        return rows.where(most * (100 + p) >= (F.col("n_a") + F.col("n_b")) * p).select("a", "b").distinct()

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """Postings of groups up to RARE, and the members (lead, key, n) of larger ones; lead is the group's smallest key, and stands for all groups that it leads."""
        rows = index_grams(self.docs, self.rule, self.frequent()).repartition("h").distinct()
        single = stored(rows.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c >= 2 or at < 0"), "groups")
        frequent = single.where((F.col("c") > RARE) | (F.col("at") < 0)).select("key")
        combined = stored(index_combinations(self.texts(frequent), self.rule).distinct(), "combinations")
        sizes = combined.groupBy("h").agg(F.count("*").alias("c"), F.min("key").alias("lead")).where("c >= 2")
        members = stored(combined.join(sizes, "h"), "groups")
        released(combined)
        small = single.where((F.col("c") <= RARE) & (F.col("at") >= 0)).select("h", "key", "n", "at")
        large = stored(members.where(F.col("c") > RARE).select("lead", "key", "n").distinct(), "large")
        return small.unionByName(members.where(F.col("c") <= RARE).select("h", "key", "n", "at")), large

    def labels(self) -> DataFrame:
        """key, root of every class that is linked with another; root is a key."""
        small, large = self.groups()
        stars = large.where("key != lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
        near = stored(self.near(self.pairs(small).unionByName(stars).distinct()), "near", SET_ROWS)
        # One link a node first; a pair whose ends that has joined needs no proof.
        first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = self.joined(stored(self.verified(first), "links", SET_ROWS), near)
        released(near)
        if not large.isEmpty():
            links = self.across(links, large)
        return components(links).select(F.col("node").alias("key"), F.col("component").alias("root"))

    def apart(self, roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs that lie in different components."""
        for side in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("component").alias(f"root_{side}")), side, "left")
        return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def joined(self, links: DataFrame, near: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """The links and those of the near pairs that they don't connect; roots: the links' components, if they are known."""
        rest = stored(self.apart(components(links) if roots is None else roots, near), "rest")
        return stored(links.unionByName(self.verified(rest)), "links", SET_ROWS)

    def across(self, links: DataFrame, large: DataFrame) -> DataFrame:
        """Adds the links between members of large groups that lie in different components so far."""
        roots = components(links)
        rows = large.join(roots.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("root", F.coalesce("component", "key")).drop("component")
        rows = stored(rows, "rooted")
        mixed = rows.groupBy("lead").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), F.min_by("root", "key").alias("main")).where("x != y").select("lead", "c", "main")
        rows = stored(rows.join(mixed, "lead"), "mixed")
        # Leads (as many as the set's parts at most) and bitmaps meet by key before the rows, which repeat a key, carry them.
        own = rows.groupBy("key").agg(F.collect_set("lead").alias("leads")).join(self.classes.select("key", "bitmap"), "key")
        rows = rows.join(own, "key")
        # Members of the leader's component need no comparison with each other, so their blocks meet only blocks of the rest.
        block = F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / BLOCK).cast("long"))
        blocks = rows.groupBy("lead", (F.col("root") == F.col("main")).alias("inner"), block.alias("block")).agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("sizes"), F.collect_list("root").alias("roots"), F.collect_list("bitmap").alias("maps"), F.collect_list("leads").alias("leads"))
        blocks = stored(blocks, "blocks")
        a, b = (blocks.select("lead", F.col("inner").alias(f"inner_{x}"), F.col("block").alias(f"block_{x}"), F.struct("keys", "sizes", "roots", "maps", "leads").alias(x)) for x in "ab")
        rule = self.rule

        @trimmed
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lead, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    found = set(_near_blocks(lead, _Block(x), _Block(y), rule))
                    if found:
                        yield pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["a", "b"])

        met = a.join(b, "lead").where("not inner_a and (inner_b or block_a <= block_b)").select("lead", "a", "b")
        near = stored(met.mapInArrow(task, "a long, b long").distinct(), "near", BLOCK_ROWS)
        released(blocks)
        return self.joined(links, near, roots)


class _Block:
    """Members of a lead's groups: keys, sizes, roots, leads, and bitmaps folded to the smallest one's cells."""

    def __init__(self, row: pa.StructScalar) -> None:
        keys, sizes, roots, maps = (row[name].as_py() for name in ("keys", "sizes", "roots", "maps"))
        self.keys, self.sizes, self.roots = (np.array(x, np.int64) for x in (keys, sizes, roots))
        self.leads = [set(x) for x in row["leads"].as_py()]
        self.least = min(map(len, maps))
        self.maps = maps

    def folded(self, size: int) -> np.ndarray:
        out = np.zeros((len(self.maps), size), np.uint8)
        for i, m in enumerate(self.maps):
            x = np.frombuffer(m, np.uint8)
            out[i] = np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
        return out


def _near_blocks(lead: int, x: _Block, y: _Block, rule: Rule) -> Iterator[tuple[int, int]]:
    """Pairs of different components that sizes and bitmaps allow, smaller key first; of all leads that hold a pair only the least gives it."""
    size = min(x.least, y.least)
    a, b = x.folded(size), y.folded(size)
    for i in range(len(a)):
        differ = np.bitwise_count(a[i] ^ b).sum(axis=1, dtype=np.int64)
        total = x.sizes[i] + y.sizes
        ok = (differ <= total * (100 - rule.percent) // (100 + rule.percent)) & (x.roots[i] != y.roots)
        ok &= np.maximum(x.sizes[i], y.sizes) * rule.percent <= 100 * np.minimum(x.sizes[i], y.sizes)
        for j in np.flatnonzero(ok).tolist():
            if min(x.leads[i] & y.leads[j]) == lead:
                yield min(int(x.keys[i]), int(y.keys[j])), max(int(x.keys[i]), int(y.keys[j]))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row of docs.

    docs: doc_id, text; other columns are ignored. component_id is the smallest
    doc_id reachable by links, itself included. A null, empty or wordless text
    has an empty set and no link. Rows with a null doc_id keep a null
    component_id if nothing links them. Equal rows are in one component. An
    empty table gives no rows.
    """
    run = Join(docs, n, percent)
    roots = run.labels()
    classes = run.classes.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = classes.join(least, "root").select("key", "component_id")
    out = run.measured.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
