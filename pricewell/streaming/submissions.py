"""Streams of submissions: each is taken once, and the days that a late one touches are computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewell.streaming.state import taken_once

KEYS = ["reporter_id", "idempotency_key"]
WINDOW_DAYS = 7


def new_rows(batch: DataFrame, known: DataFrame | None, batch_id: int) -> DataFrame:
    """The batch's rows whose key no other batch has stored; of rows with one key the one that arrived first. Rows with a null in the key are all different: each stays."""
    whole = F.lit(True)
    for k in KEYS:
        whole = whole & F.col(k).isNotNull()
    first = F.min(F.struct("ingested_at", *[c for c in batch.columns if c not in (*KEYS, "ingested_at")]))
    rows = batch.where(whole).groupBy(*KEYS).agg(first.alias("r")).select(*KEYS, "r.*").select(*batch.columns)
    rows = rows if known is None else rows.join(known.where(F.col("batch") != batch_id).select(*KEYS), KEYS, "left_anti")
    return rows.unionByName(batch.where(~whole))


def touched(rows: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """location_id, as_of, stale_since: the days that see an observation, from its own on; however late it came."""
    day = F.explode(F.sequence(F.to_date("observed_at"), F.date_add(F.to_date("observed_at"), window)))
    return rows.select("location_id", day.alias("as_of"), "ingested_at").groupBy("location_id", "as_of").agg(F.min("ingested_at").alias("stale_since"))


def ingest(submissions: DataFrame, table: str, stale: str, checkpoint: str, window: int = WINDOW_DAYS, trigger: dict | None = None) -> StreamingQuery:
    """Runs the stream into two Parquet tables, a folder a batch: new submissions, and the cells they touch.

    submissions: reporter_id, idempotency_key, location_id, observed_at,
    ingested_at and other columns. Which keys were taken is state of the stream,
    so no batch reads what others have written; rows without a whole key all
    stay. No row is dropped for being late. A batch that is run again after a
    failure finds the state before it and replaces its own folders.
    """

    def write(rows: DataFrame, batch_id: int, path: str) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id, table)
        try:
            rows = batch.sparkSession.read.parquet(f"{table}/batch={batch_id}")  # what was stored, and nothing computed twice
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return  # the batch was empty
        write(touched(rows, window), batch_id, stale)

    return taken_once(submissions, KEYS).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def due(stale: DataFrame, done: DataFrame | None, now, grace_seconds: int = 60, most: int = 500) -> DataFrame:
    """The oldest cells that are stale for the grace period, ``most`` at once (a drain's size; later drains take the rest).

    stale: location_id, as_of, stale_since, a row for each batch that touched a
    cell; done: location_id, as_of, computed_at of cells that were computed.
    """
    rows = stale
    if done is not None:
        last = done.groupBy("location_id", "as_of").agg(F.max("computed_at").alias("computed_at"))
        rows = stale.join(last, ["location_id", "as_of"], "left").where("computed_at is null or stale_since > computed_at")
    cells = rows.groupBy("location_id", "as_of").agg(F.min("stale_since").alias("stale_since"))
    return cells.where(F.col("stale_since") <= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(grace_seconds))).orderBy("stale_since", "as_of", "location_id").limit(most)


def drain(stale: DataFrame, done: DataFrame | None, now, compute: Callable[[DataFrame], None], **limits) -> int:
    """Calls compute with the due cells; returns how many there were."""
    cells = due(stale, done, now, **limits)
    n = cells.count()
    if n:
        compute(cells)
    return n
