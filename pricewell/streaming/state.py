"""Keyed state on streams: submissions taken once, and reporters' Beta counters. State lives in the checkpoint, so a restart carries on and no batch reads a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Both counters of a reporter without verdicts.
PRIOR = 2.0


def _store(stream: DataFrame) -> None:
    """Keyed processors need a store with column families."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Once(StatefulProcessor):
    """Lets the first row of a key pass; of rows that come together the one that arrived first."""

    def __init__(self, arrived: str) -> None:
        self.arrived = arrived

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            row = part.sort_values([self.arrived, *(c for c in part.columns if c != self.arrived)], kind="stable").head(1)
            if first is None or row[self.arrived].iloc[0] < first[self.arrived].iloc[0]:
                first = row
        if not self.taken.exists() and first is not None:
            self.taken.update((True,))
            yield first

    def close(self) -> None:
        pass


def taken_once(submissions: DataFrame, keys: list[str], arrived: str = "ingested_at") -> DataFrame:
    """The stream with one row a key, ever; rows with a null in the key are all different and all pass.

    A key costs a small entry in the state store, whose size is that of all
    keys; partitions hold it by hash of the key.
    """
    _store(submissions)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    once = submissions.where(whole).groupBy(*keys).transformWithStateInPandas(_Once(arrived), submissions.schema, "Append", "None")
    return once.unionByName(submissions.where(~whole))


class _Counters(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "accepted long, rejected long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        accepted, rejected = self.counts.get() if self.counts.exists() else (0, 0)
        for part in rows:
            accepted += int((part["verdict"] == "accepted").sum())
            rejected += int((part["verdict"] == "rejected").sum())
        self.counts.update((accepted, rejected))
        yield pd.DataFrame({"reporter_id": [key[0]], "alpha": [PRIOR + accepted], "beta": [PRIOR + rejected]})

    def close(self) -> None:
        pass


def reputations(verdicts: DataFrame) -> DataFrame:
    """reporter_id, alpha, beta of every reporter whose counters a batch moves. verdicts: reporter_id long, verdict; other verdicts than accepted and rejected count for neither, a null reporter is left out."""
    _store(verdicts)
    rows = verdicts.where("reporter_id is not null").select("reporter_id", "verdict")
    return rows.groupBy("reporter_id").transformWithStateInPandas(_Counters(), "reporter_id long, alpha double, beta double", "Update", "None")
