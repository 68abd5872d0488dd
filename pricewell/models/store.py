"""Versioned models: parts first, then the manifest, so a version is seen whole or not at all."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


class IncompatibleModel(ValueError):
    """The stored model was fitted on other facts than those it is asked to serve."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the whole versions, ascending."""
    fs, at = _files(spark, f"{folder}/{name}")
    if not fs.exists(at):
        return []
    found = [re.fullmatch(r"v(\d{6})", s.getPath().getName()) for s in fs.listStatus(at)]
    numbers = sorted(int(m[1]) for m in found if m)
    return [n for n in numbers if fs.exists(_files(spark, f"{folder}/{name}/v{n:06d}/manifest/_SUCCESS")[1])]


def save(spark: SparkSession, folder: str, name: str, facts: dict, rows: DataFrame) -> int:
    """Stores a model as the next version of its name; facts are what JSON can hold. A version that another writer has begun is never overwritten: the later one fails."""
    fs, at = _files(spark, f"{folder}/{name}")
    taken = [int(m[1]) for s in (fs.listStatus(at) if fs.exists(at) else []) if (m := re.fullmatch(r"v(\d{6})", s.getPath().getName()))]
    version = max(taken, default=0) + 1
    path = f"{folder}/{name}/v{version:06d}"
    rows.write.parquet(f"{path}/parts")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return version


def load(spark: SparkSession, folder: str, name: str, expected: dict, version: int | None = None) -> tuple[dict, DataFrame]:
    """facts and rows of the newest version, or the given one.

    expected: facts that must be equal, such as the features in their order: a
    model reads them by position, so another order would give numbers that look
    like any others. Where one differs IncompatibleModel is raised; without a
    whole version, FileNotFoundError.
    """
    held = versions(spark, folder, name)
    version = version or (held[-1] if held else None)
    if version not in held:
        raise FileNotFoundError(f"no version {version or ''} of {name} in {folder}")
    path = f"{folder}/{name}/v{version:06d}"
    facts = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    for key, value in expected.items():
        if facts.get(key) != value:
            raise IncompatibleModel(f"{name} version {version} was fitted with {key} {facts.get(key)}, not {value}")
    return facts, spark.read.parquet(f"{path}/parts")
