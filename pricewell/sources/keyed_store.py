"""A table whose rows are replaced by key, and whose readers see one state or the next, never a mixture.

Rows lie in folders, one or more a part (a month, say). A manifest names the
folder of every part; a change writes the changed parts anew and then publishes
the next manifest. Nothing that an earlier manifest names is touched, so a reader
that has begun goes on reading the state it began with, and a writer that dies
leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times a change is made again on a newer state, where another writer was first.
TRIES = 5


class Conflict(RuntimeError):
    """Other writers published first, each time."""


class KeyedStore:
    """path: a folder that driver and executors share. part: the column whose values are the parts, as strings; few enough for one manifest."""

    def __init__(self, spark: SparkSession, path: str, part: str) -> None:
        self.spark, self.path, self.part = spark, path, part

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest published state; 0 before the first."""
        fs, at = self._file("manifests")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"(\d{8})\.json", n))), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """part -> folder of a state, the newest if none is given."""
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:08d}.json").first()["value"]) if version else {}

    def read(self, version: int | None = None, wanted: Callable[[str], bool] = lambda part: True) -> DataFrame | None:
        """The rows of a state; None if no wanted part has any. wanted: which parts to read; the others' folders are not opened."""
        held = [f"{self.path}/{folder}" for part, folder in self.folders(version).items() if wanted(part)]
        return self.spark.read.parquet(*held) if held else None

    def _publish(self, version: int, folders: dict[str, str]) -> bool:
        """Whether the manifest could be put in place: written aside, then renamed, which never replaces another writer's."""
        fs, to = self._file(f"manifests/{version:08d}.json")
        _, aside = self._file(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.exists(to) and fs.rename(aside, to):
            return True
        fs.delete(aside, False)
        return False

    def replace(self, rows: DataFrame, keys: list[str]) -> int:
        """All stored rows with a key that rows have give way to rows; the new state's version.

        keys: columns that decide what is replaced, e.g. a snapshot's, to replace
        its items alone. A key's rows belong to one part. Repeating a change
        changes nothing. Rows without a part are refused. Parts that rows don't
        touch are kept as they are; no rows leave the state as it is.
        """
        values = [r[0] for r in rows.select(F.col(self.part).cast("string")).distinct().collect()]  # few, by contract
        if None in values:
            raise ValueError(f"rows without {self.part}")
        if not values:
            return self.version()
        for _ in range(TRIES):
            version = self.version()
            folders = self.folders(version)
            kept = self.read(version, lambda part: part in values)
            merged = rows if kept is None else rows.unionByName(kept.join(rows.select(*keys).distinct(), keys, "left_anti"))
            fresh = f"data/{uuid.uuid4().hex}"
            spread = merged.withColumn("_part", F.col(self.part).cast("string"))
            spread.repartition("_part", *keys).write.partitionBy("_part").parquet(f"{self.path}/{fresh}")
            fs, at = self._file(fresh)
            made = {self._value(s.getPath().getName()): s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("_part=")}
            if self._publish(version + 1, folders | {part: f"{fresh}/{name}" for part, name in made.items()}):
                return version + 1
        raise Conflict(f"{TRIES} other changes of {self.path} came first")

    def _value(self, folder: str) -> str:
        """The part that Spark's folder name stands for."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.removeprefix("_part="))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest ``keep`` states names, and older manifests; how many folders went. Not beside writers."""
        newest = self.version()
        states = range(max(1, newest - keep + 1), newest + 1)
        named = {folder.split("/")[1] for v in states for folder in self.folders(v).values()}
        fs, at = self._file("data")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        for v in range(1, newest - keep + 1):
            fs, old = self._file(f"manifests/{v:08d}.json")
            fs.delete(old, False)
        return len(gone)
