"""Matching of typed product names with a catalogue: lexical scores, package sizes, vectors, and how signals are joined.

A catalogue is a table of variants (item, variant) as large as a country's
basket; texts are many. Texts are compared once each, however often they occur,
with all variants, block by block: a text is repeated for each block of variants
and joined with it by number, so neither side has to fit in one task. Inside a
block bounds on the score spare most exact comparisons and change no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.operators.text import normalise

LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.4, 0.6
# What a size that agrees or contradicts adds to a score, and up to and from which ratio.
AGREES, CONTRADICTS = (1.4, 0.05), (3.0, -0.12)
# From which confidence a match is taken or reviewed, and the lead it needs over the next.
AUTO, REVIEW, LEAD, EXACT = 0.85, 0.55, 0.05, 0.99
#: Vectors of a block in the nearest-neighbour search.
BLOCK = 2048


def tokens(text: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; rows of the table are bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _alike(a: str, b: str) -> float:
    return 2.0 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_score(a: str, b: str) -> float:
    """Best likeness of the shared words, and these with each side's other words; 0 if a side is empty, 1 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 1.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    scores = [_alike(with_x, with_y)]
    if both:
        scores += [_alike(both, with_x), _alike(both, with_y)]
    return max(scores)


def token_set_ratio(a: Column, b: Column) -> Column:
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(scored, "double")(a, b)


class Variants:
    """A block of variants, ordered for search: the best items of a text without scoring every variant."""

    def __init__(self, items: list, texts: list[str]) -> None:
        self.items, self.texts = items, texts
        self.words = [set(t.split()) for t in texts]
        letters = sorted({c for t in texts for c in t})
        self.at = {c: i for i, c in enumerate(letters)}
        self.counts = np.zeros((len(texts), len(letters)), np.int32)
        for row, ws in enumerate(self.words):
            for c in " ".join(sorted(ws)):
                self.counts[row, self.at[c]] += 1
        self.lengths = self.counts.sum(axis=1)

    def best(self, text: str, limit: int) -> list[tuple]:
        """(score, item, variant) of the best ``limit`` items by their best variant; ties go to the smaller item and variant.

        Without a shared word the score is twice the common subsequence over both
        lengths, and that is no longer than the letters in common: so variants
        are scored from the highest bound down until no bound reaches the least
        item that is kept. A variant with a shared word is always scored.
        """
        words = set(text.split())
        own = np.zeros(len(self.at), np.int32)
        plain = " ".join(sorted(words))
        for c in plain:
            if c in self.at:
                own[self.at[c]] += 1
        bound = 2.0 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(self.lengths + len(plain), 1)
        bound[[bool(words & w) for w in self.words]] = 2.0
        found: dict = {}
        least = -1.0
        for i in np.argsort(-bound, kind="stable").tolist():
            if len(found) >= limit and bound[i] + 1e-12 < least:
                break
            score = token_set_score(text, self.texts[i])
            before = found.get(self.items[i])
            if before is None or (-score, self.texts[i]) < before:
                found[self.items[i]] = (-score, self.texts[i])
                if len(found) >= limit:
                    least = -sorted(v[0] for v in found.values())[limit - 1]
        ranked = sorted((score, item, variant) for item, (score, variant) in found.items())[:limit]
        return [(-score, item, variant) for score, item, variant in ranked]


def lexical_search(texts: DataFrame, variants: DataFrame, limit: int = 10) -> DataFrame:
    """text, item, score, variant: the best ``limit`` items of each distinct normalised text, by their best variant.

    texts: text; variants: item, variant. Every variant counts, also for texts of
    one or two letters; a score of 0 is no candidate. Ties go to the smaller item
    and variant. A null or empty text has no row; an empty catalogue gives none.
    """
    queries = texts.select(normalise(F.col("text")).alias("text")).where("text != ''").distinct()
    known = variants.select("item", normalise(F.col("variant")).alias("variant")).where("variant != '' and item is not null").distinct()
    kind, many = known.schema["item"].dataType, max(1, -(-known.count() // BLOCK))
    blocks = known.groupBy(F.pmod(F.xxhash64("variant"), F.lit(many)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("variant", "item"))).alias("rows"))  # BLOCK rows on average
    met = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).join(blocks, "block").select("text", "block", "rows.item", "rows.variant")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("item", kind), T.StructField("score", T.DoubleType()), T.StructField("variant", T.StringType())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Variants] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, (text, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if block not in held:
                    held.clear()  # one block at a time
                    held[block] = Variants(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                out += [(text, item, score, variant) for score, item, variant in held[block].best(text, limit)]
            kinds = (pa.string(), batch.schema.field(2).type.value_type, pa.float64(), pa.string())
            yield pa.record_batch([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["text", "item", "score", "variant"])

    found = met.sortWithinPartitions("block").mapInArrow(task, schema).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "item"))
    best = found.groupBy("text", "item").agg(F.max("score").alias("score"), F.min_by("variant", F.struct(-F.col("score"), F.col("variant"))).alias("variant"))
    return best.withColumn("k", rank).where(F.col("k") <= limit).drop("k")


def fuse(lexical: DataFrame, semantic: DataFrame | None, keys: list[str], weights: tuple[float, float] = (LEXICAL_WEIGHT, SEMANTIC_WEIGHT), query: list[str] | None = None) -> DataFrame:
    """keys, lexical, semantic, fused: the weighted mean of both scores, a missing side 0.

    query: those of the keys that name the text; none: both tables are of one
    text. A text without any semantic row has a signal absent, not against it:
    its fused scores are the lexical ones, as they are without a semantic table.
    """
    query, zero = query or [], F.lit(0.0)
    left = lexical.select(*keys, F.col("score").alias("lexical"))
    if semantic is None or (not query and semantic.isEmpty()):
        return left.withColumns({"semantic": zero, "fused": F.col("lexical")})
    a, b = (w / sum(weights) if sum(weights) > 0 else 0.5 for w in weights)
    both = left.join(semantic.select(*keys, F.col("score").alias("semantic")), keys, "full")
    if query:
        both = both.join(semantic.select(*query).distinct().withColumn("_known", F.lit(True)), query, "left")
    known = F.col("_known").isNotNull() if query else F.lit(True)
    filled = both.withColumns({"lexical": F.coalesce("lexical", zero), "semantic": F.coalesce("semantic", zero)})
    return filled.select(*keys, "lexical", "semantic", F.when(known, a * F.col("lexical") + b * F.col("semantic")).otherwise(F.col("lexical")).alias("fused"))


def calibrate(score: Column) -> Column:
    """Confidence of a fused score where nothing was fitted."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.6 * (score - 0.5)))


def fit_calibration(labelled: DataFrame):
    """An isotonic model of score and label (0 or 1), or None with under 300 rows or 50 of a label."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    counts = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("right")).first()
    if counts["n"] < 300 or min(counts["right"], counts["n"] - counts["right"]) < 50:
        return None
    rows = VectorAssembler(inputCols=["score"], outputCol="features").transform(labelled.select("score", F.col("label").cast("double")))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)


def parse_sizes(text: Column, units: list[tuple[str, str, float, list[str]]]) -> Column:
    """array<struct<quantity, unit>>: every stated size in its base unit.

    units: code, base unit, factor to it, aliases; a country's configuration, so
    a short list; aliases are normalised as texts are. Of aliases that begin alike
    the longest is read.
    """
    named = [(name, base, factor) for code, base, factor, names in units for name in [*names, code]]
    plain = SparkSession.active().createDataFrame([(i, n) for i, (n, _, _) in enumerate(named)], "i int, name string").select("i", normalise(F.col("name")).alias("name")).orderBy("i").collect()
    alias = {}
    for (_, base, factor), row in zip(named, plain, strict=True):
        if row["name"]:
            alias.setdefault(row["name"], (base, factor))
    if not alias:
        return F.array().cast("array<struct<quantity: double, unit: string>>")
    ordered = sorted(alias, key=len, reverse=True)
    signs = {a: re.sub(r"([^\w\s])", r"\\\1", a) for a in ordered}
    pattern = r"(\d+(?:[.,]\d+)?)\s*(" + "|".join(signs.values()) + r")(?![\p{L}\p{N}_])"
    spaced = F.regexp_replace(normalise(text), r"(?<=\p{L})(?=\d)|(?<=\d)(?=\p{L})", " ")
    base = F.create_map(*(F.lit(x) for a in ordered for x in (a, alias[a][0])))
    factor = F.create_map(*(F.lit(x) for a in ordered for x in (a, float(alias[a][1]))))
    found = F.arrays_zip(F.regexp_extract_all(spaced, F.lit(pattern), F.lit(1)).alias("q"), F.regexp_extract_all(spaced, F.lit(pattern), F.lit(2)).alias("u"))
    number = lambda s: F.replace(s["q"], F.lit(","), F.lit(".")).cast("double")
    return F.transform(found, lambda s: F.struct((number(s) * factor[s["u"]]).alias("quantity"), base[s["u"]].alias("unit")))


def size_adjustment(sizes: Column, quantity: Column, unit: Column) -> Column:
    """What the stated sizes add to a candidate's score, by the closest one in the pack's base unit."""
    same = F.filter(sizes, lambda s: (s["unit"] == unit) & (s["quantity"] > 0))
    ratio = F.array_min(F.transform(same, lambda s: F.greatest(s["quantity"], quantity) / F.least(s["quantity"], quantity)))
    move = F.when(ratio <= AGREES[0], AGREES[1]).when(ratio >= CONTRADICTS[0], CONTRADICTS[1]).otherwise(0.0)
    return F.when((quantity > 0) & (F.size(same) > 0), move).otherwise(0.0)


def decide(candidates: DataFrame, key: str) -> DataFrame:
    """key, item, confidence, action of each key's best candidate. candidates: key, item, fused, confidence; ties go to the smaller item. A lead over the next one under ``LEAD`` in fused score is never taken without review."""
    w = Window.partitionBy(key).orderBy(F.desc("fused"), "item")
    rows = candidates.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("fused").over(w)).where("k = 1")
    c = F.col("confidence")
    close = F.coalesce(F.col("fused") - F.col("next") < LEAD, F.lit(False))
    return rows.select(key, "item", "confidence", F.when((c >= AUTO) & ~close, "auto_resolve").when(c >= REVIEW, "review").otherwise("reject").alias("action"))


def candidates(texts: DataFrame, variants: DataFrame, limit: int = 5, semantic: DataFrame | None = None, packs: DataFrame | None = None, units: list[tuple[str, str, float, list[str]]] | None = None) -> DataFrame:
    """text, item, lexical, semantic, fused, confidence, rank: the best ``limit`` items of each distinct normalised text.

    Both signals give three times as many items, which are fused. semantic: text,
    item, score of normalised texts (``semantic.search``). packs: item, quantity,
    unit, and units: sizes that a text states move its items' scores.
    """
    hits = lexical_search(texts, variants, 3 * limit)
    both = fuse(hits, semantic, ["text", "item"], query=["text"])
    if packs is not None and units:
        sized = both.join(F.broadcast(packs.select("item", "quantity", "unit")), "item", "left").withColumn("_sizes", parse_sizes(F.col("text"), units))
        both = sized.withColumn("fused", F.col("fused") + F.coalesce(size_adjustment(F.col("_sizes"), F.col("quantity"), F.col("unit")), F.lit(0.0))).drop("_sizes", "quantity", "unit")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("fused"), "item"))
    return both.withColumns({"confidence": calibrate(F.col("fused")), "rank": rank}).where(F.col("rank") <= limit)


def match_many(texts: DataFrame, variants: DataFrame, limit: int = 5, search=None, packs: DataFrame | None = None, units: list[tuple[str, str, float, list[str]]] | None = None) -> DataFrame:
    """text, item, confidence, action: exact variants first, and only the other texts are searched; one row a distinct text.

    search: (texts, variants, limit) -> text, item, score, the semantic signal
    (``semantic.search``); None: lexical alone. packs and units as in
    ``candidates``. An empty text, or one with no candidate, is rejected without
    an item.
    """
    queries = texts.select("text", normalise(F.col("text")).alias("t")).distinct()
    known = variants.select(normalise(F.col("variant")).alias("t"), "item").groupBy("t").agg(F.min("item").alias("item"))
    exact = queries.where("t != ''").join(known, "t").select("text", "item", F.lit(EXACT).alias("confidence"), F.lit("auto_resolve").alias("action"))
    rest = queries.join(known, "t", "left_anti")
    asked = rest.select(F.col("t").alias("text")).where("text != ''").distinct()
    found = candidates(asked, variants, limit, search(asked, variants, 3 * limit) if search else None, packs, units)
    decided = decide(found.withColumnRenamed("text", "t"), "t")
    chosen = rest.join(decided, "t", "left").select("text", "item", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("action", F.lit("reject")).alias("action"))
    return exact.unionByName(chosen)


def _blocks(vectors: DataFrame) -> DataFrame:
    """block, ids, data: up to BLOCK unit vectors a row; zero vectors are left out."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                lists = part.column(1)
                data = np.stack([np.asarray(v, np.float64) for v in lists.to_pylist()])
                norms = np.linalg.norm(data, axis=1)
                keep = norms > 0
                ids = part.column(0).to_numpy()[keep]
                yield pa.record_batch([pa.array([ids.tobytes()]), pa.array([(data[keep] / norms[keep, None]).tobytes()])], names=["ids", "data"])

    rows = vectors.select(F.col("id").cast("long"), "vector").where("id is not null and vector is not null").mapInArrow(task, "ids binary, data binary")
    return rows.where("length(ids) > 0")


def vector_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank, score: the k vectors of greatest cosine to each query, itself left out; ties go to the smaller id.

    Both tables: id, vector. All queries meet all vectors, block by block: every
    block of queries is sent to every block of vectors, and only k rows of each
    meeting leave it.
    """
    q = _blocks(queries).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = _blocks(vectors).join(q)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                scores = np.frombuffer(q_data).reshape(len(q_ids), -1) @ np.frombuffer(data).reshape(len(ids), -1).T
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                for row, query in zip(scores, q_ids, strict=True):
                    best = np.lexsort((ids, -row))[:k]
                    best = best[np.isfinite(row[best])]
                    yield pa.record_batch([pa.array(np.full(len(best), query)), pa.array(ids[best]), pa.array(row[best])], names=["query_id", "id", "score"])

    found = met.select("ids", "data", "q_ids", "q_data").mapInArrow(task, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", clipped)
