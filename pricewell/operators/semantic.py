"""The semantic signal: hashed character n-gram vectors of texts, and an index of vector cells instead of all pairs.

Vectors need no fitted model: runs of two to four letters, with marks at the ends
of words, are hashed into ``WIDTH`` signed buckets and weighed by the logarithm of
their count. Given vectors (a table of embeddings) serve as well. The index puts
every vector into the cell of its nearest centre. A bounded sample gives the
centres, and says in how many of its nearest cells a query has to look: vectors
without clusters need far more than clustered ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.text import normalise
from pricewell.sources.scratch import stored

WIDTH, GRAMS = 512, (2, 3, 4)
#: Vectors that the centres are fitted on at most; centres at most; steps of fitting; rows of a block in a cell.
SAMPLE, CELLS, STEPS, BLOCK = 20_000, 1024, 12, 1024
#: Share of the sample's own neighbours whose cells a query has to look into; queries and neighbours that it is measured on; cells at least.
COVERED, MEASURED, LEAST_PROBES = 0.95, (256, 10), 4
#: Rows that a task gathers before it leaves each query its best.
GATHERED = 200_000


def vector_of(text: str, width: int = WIDTH) -> np.ndarray:
    """The unit vector of a normalised text; zeros for an empty one."""
    out: dict[int, float] = {}
    counts: dict[str, int] = {}
    for word in text.split():
        marked = f"<{word}>"
        for n in GRAMS:
            for i in range(len(marked) - n + 1):
                gram = marked[i : i + n]
                counts[gram] = counts.get(gram, 0) + 1
    for gram, n in counts.items():
        h = zlib.crc32(gram.encode())
        out[h % width] = out.get(h % width, 0.0) + (1.0 if h >> 31 else -1.0) * (1.0 + np.log(n))
    vector = np.zeros(width, np.float32)
    vector[list(out)] = list(out.values())
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm else vector


def embed(texts: DataFrame) -> DataFrame:
    """texts (text) with vector, of each row's normalised text; a null text counts as empty."""
    rows = texts.select("text", normalise(F.col("text")).alias("_t"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [vector_of(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(vectors) if vectors else np.zeros(0, np.float32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * WIDTH), pa.array(flat))], names=["text", "vector"])

    return rows.mapInArrow(task, "text string, vector array<float>")


def _unit(lists: pa.Array) -> np.ndarray:
    data = np.stack([np.asarray(v, np.float32) for v in lists.to_pylist()]) if len(lists) else np.zeros((0, 1), np.float32)
    norms = np.linalg.norm(data, axis=1, keepdims=True)
    return data / np.where(norms > 0, norms, 1.0)


def fit_cells(vectors: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> tuple[np.ndarray, int] | None:
    """Centres (unit rows), and how many of its nearest cells a query looks into; None without vectors.

    Centres, about the square root of the number of vectors, come from spherical
    k-means on at most ``sample`` of them, which a hash of their id picks. So many
    cells are looked into that they hold ``COVERED`` of the true neighbours of
    some of the sample within it.
    """
    vectors = vectors.where("id is not null and vector is not null")
    n = vectors.count()
    if not n:
        return None
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, 0.9 * sample / n) * (1 << 20)) + 1) if n > sample else vectors
    data = _unit(picked.select("vector").limit(sample).toArrow().column(0).combine_chunks())  # at most ``sample`` rows
    rng = np.random.default_rng(11)
    many = max(1, min(cells, int(n**0.5), len(data)))
    centres = data[rng.choice(len(data), many, replace=False)].copy()
    for _ in range(STEPS):
        own = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    centres = centres.astype(np.float32)
    asked = rng.choice(len(data), min(MEASURED[0], len(data)), replace=False)
    alike = data[asked] @ data.T
    alike[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-alike, axis=1, kind="stable")[:, : MEASURED[1]]
    place = np.argsort(np.argsort(-(data[asked] @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell among a query's nearest ones
    held = np.take_along_axis(place, (data @ centres.T).argmax(axis=1)[near], axis=1)
    probes = int(np.quantile(held, COVERED, method="higher")) + 1
    return centres, min(many, max(LEAST_PROBES, probes))


def _placed(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """cell, ids, data: blocks of up to ``BLOCK`` vectors, each in its ``probes`` nearest cells; zero vectors are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0).to_numpy(), _unit(batch.column(1))
            some = np.abs(data).sum(axis=1) > 0
            ids, data = ids[some], data[some]
            if not len(ids):
                continue
            near = np.argsort(-(data @ shared.value.T), axis=1, kind="stable")[:, :probes]
            cell, row = near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])
            order = np.argsort(cell, kind="stable")
            cell, row = cell[order], row[order]
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, b, BLOCK):
                    own = row[i : min(i + BLOCK, b)]
                    yield pa.record_batch([pa.array([int(cell[a])], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([data[own].tobytes()])], names=["cell", "ids", "data"])

    return vectors.select(F.col("id").cast("long"), "vector").where("id is not null and vector is not null").mapInArrow(task, "cell int, ids binary, data binary")


def _best(held: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of all that is held; ties go to the smaller id."""
    query, found, score = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    keep = place < k
    return query[keep], found[keep], score[keep]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """query_id, id, rank, score: of the vectors in each query's nearest cells the k of greatest cosine, the query's own id left out; ties go to the smaller id.

    Both tables: id, vector. cells: of ``fit_cells``. Every vector is indexed. A cell's vectors come in
    blocks that are joined by cell, so a cell with a third of all rows is many
    blocks. More probes find more of the true neighbours; with all cells the
    answer is exact. Null and zero vectors have no rows, nor have empty tables.
    """
    cells = cells or fit_cells(vectors)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, rank int, score double")
    centres, probes = cells
    asked = _placed(queries, centres, min(probes, len(centres))).select("cell", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = _placed(vectors, centres, 1).join(asked, "cell")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0  # (query, id, score) columns
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                scores = (np.frombuffer(q_data, np.float32).reshape(len(q_ids), -1) @ np.frombuffer(data, np.float32).reshape(len(ids), -1).T).astype(float)
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:
                    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                    row, column = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))  # ties of the k-th stay for now
                else:
                    row, column = np.nonzero(np.isfinite(scores))
                held.append((q_ids[row], ids[column], scores[row, column]))
                rows += len(row)
                if rows >= GATHERED:
                    held, rows = [_best(held, k)], 0
        if held:
            query, found, score = _best(held, k)
            yield pa.record_batch([pa.array(query), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    found = met.select("ids", "data", "q_ids", "q_data").mapInArrow(task, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))


def search(texts: DataFrame, variants: DataFrame, limit: int) -> DataFrame:
    """text, item, score: of each distinct normalised text the best ``limit`` items, by their nearest variant; ties go to the smaller item.

    variants: item, variant. The nearest 4 x limit variants are asked for, as an
    item has several. A text without any gram has no rows.
    """
    known = stored(variants.select("item", normalise(F.col("variant")).alias("text")).where("text != '' and item is not null").distinct().withColumn("id", F.monotonically_increasing_id()), "variants")
    asked = stored(texts.select(normalise(F.col("text")).alias("text")).where("text != ''").distinct().withColumn("id", -1 - F.monotonically_increasing_id()), "texts")
    vectors = stored(known.join(embed(known.select("text").distinct()), "text").select("id", "vector"), "variant-vectors")
    queries = asked.join(embed(asked.select("text")), "text").select("id", "vector")
    near = nearest(queries, vectors, 4 * limit)
    hits = near.join(known.select("id", "item"), "id").join(asked.select(F.col("id").alias("query_id"), "text"), "query_id")
    best = hits.groupBy("text", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "item"))
    return best.withColumn("k", rank).where(F.col("k") <= limit).drop("k")
