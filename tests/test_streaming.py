"""Streams and stores: taken once, late rows, repeated batches, replaced months."""

from __future__ import annotations

import csv
import datetime as dt

import duckdb
from pyspark.sql import functions as F

from pricewell.plans import snapshots
from pricewell.sources.adapters import TABLES, with_views
from pricewell.streaming import state, submissions

SF = "/root/testdata/sf0.001"
SCHEMA = "reporter_id long, idempotency_key string, location_id long, observed_at timestamp, ingested_at timestamp, price double"


def test_ingest_once_and_late(spark, tmp_path):
    source, at = tmp_path / "in", dt.datetime(2024, 1, 10, 12)
    rows = [(1, "a", 5, at, at, 1.0), (1, "a", 5, at, at + dt.timedelta(hours=1), 2.0), (2, "a", 6, at - dt.timedelta(days=4), at, 3.0)]
    more = [(1, "a", 5, at, at + dt.timedelta(days=2), 9.0), (3, None, 6, at, at + dt.timedelta(days=2), 4.0)]
    for batch in (rows, more):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}")
        submissions.ingest(stream, f"{tmp_path}/rows", f"{tmp_path}/stale", f"{tmp_path}/cp", trigger={"availableNow": True}).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted((r["reporter_id"], r["price"]) for r in got.collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    stale = spark.read.parquet(f"{tmp_path}/stale")
    assert stale.where("location_id = 5").count() == 8 and stale.where("location_id = 6").agg(F.min("as_of")).first()[0] == dt.date(2024, 1, 6)
    again = submissions.new_rows(spark.createDataFrame(more, SCHEMA), got, 1)  # the second batch run again
    assert [r["reporter_id"] for r in again.collect()] == [3]
    loose = [(None, "x", 1, at, at, 5.0), (7, None, 1, at, at, 6.0), (7, None, 1, at, at, 6.0)]
    assert sorted(r["price"] for r in submissions.new_rows(spark.createDataFrame(rows + loose, SCHEMA), None, 0).collect()) == [1.0, 3.0, 5.0, 6.0, 6.0]
    due = submissions.due(stale, None, at + dt.timedelta(seconds=59))
    assert due.count() == 0 and submissions.due(stale, None, at + dt.timedelta(seconds=60), most=3).count() == 3
    done = stale.where("location_id = 5").select("location_id", "as_of", F.lit(at + dt.timedelta(hours=1)).alias("computed_at"))
    seen = []
    assert submissions.drain(stale, done, at + dt.timedelta(days=3), lambda c: seen.extend(c.collect())) == len(seen) > 0
    assert {r["location_id"] for r in seen} == {6}


def test_rows_without_a_key_all_pass_and_state_survives(spark, tmp_path):
    """Three runs of one stream: keys taken in one stay taken, whatever happens to the stored rows between."""
    source, at = tmp_path / "in", dt.datetime(2024, 1, 10, 12)
    batches = [[(1, "a", 5, at, at, 1.0), (None, "a", 5, at, at, 2.0), (4, None, 5, at, at, 3.0), (4, None, 5, at, at, 3.0)], [(1, "a", 5, at, at, 9.0), (1, "b", 5, at, at + dt.timedelta(hours=2), 5.0), (1, "b", 5, at, at, 4.0)], [(1, "b", 5, at, at, 9.0)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}")
        submissions.ingest(stream, f"{tmp_path}/rows-{i}", f"{tmp_path}/stale", f"{tmp_path}/cp", trigger={"availableNow": True}).awaitTermination()
    read = lambda i: sorted(r["price"] for r in spark.read.parquet(f"{tmp_path}/rows-{i}").collect())
    assert read(0) == [1.0, 2.0, 3.0, 3.0] and read(1) == [4.0] and not (tmp_path / "rows-2/batch=2").exists()


def test_reputations_carry_on(spark, tmp_path):
    source, seen = tmp_path / "in", []
    for batch in ([(1, "accepted"), (1, "accepted"), (2, "rejected"), (None, "accepted")], [(1, "rejected"), (3, "review")]):
        spark.createDataFrame(batch, "reporter_id long, verdict string").coalesce(1).write.mode("append").parquet(f"{source}")
        stream = state.reputations(spark.readStream.schema("reporter_id long, verdict string").parquet(f"{source}"))
        step = lambda rows, _: seen.append(sorted(map(tuple, rows.collect())))
        stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(1, 4.0, 2.0), (2, 2.0, 3.0)], [(1, 4.0, 3.0), (3, 2.0, 2.0)]]


def test_stored_snapshots(spark, tmp_path):
    store = f"{tmp_path}/store"
    snapshots.publish(spark, SF, store, until="1998-03")
    first = snapshots.read(spark, store).count()
    snapshots.publish(spark, SF, store, since="1998-03")
    stored = snapshots.read(spark, store)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(with_views(snapshots.TABLES["snapshots"], False)).fetchall()
    assert first < len(expected) and sorted(map(tuple, stored.collect())) == sorted(expected)
    latest = {r["location_id"]: r["as_of"] for r in snapshots.latest_per_location(stored).collect()}
    assert latest == {r[1]: max(x[0] for x in expected if x[1] == r[1]) for r in expected}
    assert snapshots.national_series(stored).count() <= 91
    locations = spark.createDataFrame([(i, f"L{i}") for i in range(25)], "location_id long, name string")
    snapshots.export(stored.where("as_of = date'1998-03-20'"), locations, f"{tmp_path}/csv", {"as_of": "#date", "cost_local": "#value"})
    lines = spark.read.text(f"{tmp_path}/csv").collect()
    assert lines[0]["value"].startswith("as_of,location_id") and next(csv.reader([lines[1]["value"]]))[:5] == ["#date", "", "", "", "#value"]
    assert len(lines) == 2 + stored.where("as_of = date'1998-03-20'").select("location_id").distinct().count()
