"""The store of states: keys replaced, readers undisturbed, lost writers and conflicts; imports repeated without their ledger line."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from pricewell.plans import snapshots
from pricewell.sources import partner_files
from pricewell.sources.keyed_store import Conflict, KeyedStore

ROWS = "part string, key long, n long"


def rows(store, **options):
    held = store.read(**options)
    return sorted(map(tuple, held.select("part", "key", "n").collect())) if held is not None else []


def test_keys_are_replaced_and_readers_keep_their_state(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "part")
    make = lambda r: spark.createDataFrame(r, ROWS)
    assert store.version() == 0 and store.read() is None
    assert store.replace(make([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b/=", 9, 4)]), ["key"]) == 1
    before = store.read()
    assert store.replace(make([("a", 1, 5)]), ["key"]) == 2  # both rows of key 1 give way to one
    assert sorted(map(tuple, before.select("part", "key", "n").collect())) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b/=", 9, 4)]
    now = [("a", 1, 5), ("a", 2, 3), ("b/=", 9, 4)]
    assert rows(store) == now and rows(store, version=1) != now
    assert store.replace(make([("a", 1, 5)]), ["key"]) == 3 and rows(store) == now  # a repeat
    assert store.replace(make([]), ["key"]) == 3
    assert rows(store, wanted=lambda part: part == "b/=") == [("b/=", 9, 4)]
    with pytest.raises(ValueError):
        store.replace(make([(None, 1, 1)]), ["key"])
    make([("z", 7, 7)]).write.parquet(f"file://{tmp_path}/s/data/lost/_part=z")  # a writer that died
    assert rows(store) == now and store.vacuum(keep=1) >= 2 and rows(store) == now and store.version() == 3


def test_a_writer_that_comes_second_works_on_the_newer_state(spark, tmp_path, monkeypatch):
    store, other = (KeyedStore(spark, f"file://{tmp_path}/s", "part") for _ in range(2))
    make = lambda r: spark.createDataFrame(r, ROWS)
    store.replace(make([("a", 1, 1), ("a", 2, 2)]), ["key"])
    publish, met = store._publish, []

    def late(version, folders):
        if not met:
            met.append(other.replace(make([("a", 2, 20)]), ["key"]))
        return publish(version, folders)

    monkeypatch.setattr(store, "_publish", late)
    assert store.replace(make([("a", 1, 10)]), ["key"]) == 3 and rows(store) == [("a", 1, 10), ("a", 2, 20)]
    monkeypatch.setattr(store, "_publish", lambda *_: False)
    with pytest.raises(Conflict):
        store.replace(make([("a", 1, 0)]), ["key"])


def test_one_snapshots_items_alone(spark, tmp_path):
    made = spark.createDataFrame([("1998-03-01", 1, 1, "rice", 2.0), ("1998-03-01", 1, 1, "oil", 3.0), ("1998-03-01", 2, 1, "rice", 4.0), ("1998-04-01", 1, 1, "rice", 5.0)], "as_of string, location_id long, version int, item string, price double")
    made, store = made.withColumn("as_of", F.col("as_of").cast("date")), f"file://{tmp_path}/store"
    snapshots.replace(made, store, "snapshot_items")
    one = made.where("location_id = 1 and item = 'rice' and as_of < date'1998-04-01'").withColumn("price", F.lit(9.0))
    snapshots.replace(one, store, "snapshot_items", ("as_of", "location_id", "version"))
    held = snapshots.read(spark, store, "snapshot_items")
    assert sorted((str(r["as_of"]), r["location_id"], r["item"], r["price"]) for r in held.collect()) == [("1998-03-01", 1, "rice", 9.0), ("1998-03-01", 2, "rice", 4.0), ("1998-04-01", 1, "rice", 5.0)]
    assert snapshots.read(spark, store, "snapshot_items", since="1998-04").count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, store, "nothing")


def test_import_without_its_ledger_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Product,Price,Market,Unit,Date\nrice,6.5,one,kg,2026-03-15\nmilk,7,one,l,2026-03-16\n")
    locations = spark.createDataFrame([(1, "one", "One", None)], "location_id long, slug string, name string, name_local string")
    load = lambda: partner_files.import_file(spark, f"{tmp_path}/in.csv", "shop", f"{tmp_path}/ledger", f"{tmp_path}/rows", locations, ["kg", "l"], "xts")
    assert load()["accepted"] == 2
    shutil.rmtree(tmp_path / "ledger")  # died before it was written
    assert load()["status"] == "completed"
    keys = [r["row_key"] for r in spark.read.parquet(f"{tmp_path}/rows").collect()]
    assert len(keys) == len(set(keys)) == 2
